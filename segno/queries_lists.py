"""Queries of ranked lists in detail."""

from __future__ import annotations

from segno.operators import critics as K
from segno.queries_core import _picks, _plays
from segno.queries_reports import ARTIST

QUERIES = {
    "critics_spellings": lambda s, d: K.spellings(_picks(s, d)),
    "validated_insights": lambda s, d: K.validated_insights(_picks(s, d), _plays(s, d), 2),
    "alignment_years": lambda s, d: K.alignment(K.in_years(_picks(s, d), 2014, 2017), _plays(s, d)),
    "critic_picks": lambda s, d: K.critic_picks(_picks(s, d), _plays(s, d)),
    "review_summary": lambda s, d: K.review_summary(_picks(s, d)),
    "review_albums": lambda s, d: K.review_albums(_picks(s, d), _plays(s, d), 2, 3),
    "album_listings": lambda s, d: K.album_listings(_picks(s, d), _plays(s, d)),
    "artist_in_lists": lambda s, d: K.artist_in_lists(_picks(s, d), _plays(s, d), ARTIST),
    "unheard_weighted": lambda s, d: K.unheard_weighted(_picks(s, d), _plays(s, d)),
    "champions": lambda s, d: K.champions(_picks(s, d), _plays(s, d), ARTIST),
}
