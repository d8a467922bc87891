import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from segno.functions.names import artist_key, one_slip, plain, recording_key, same_recording


@pytest.mark.parametrize(
    "shown",
    ["The Paper Estuaries", "the paper estuaries", "Paper Estuaries", "Ｔｈｅ Ｐａｐｅｒ Ｅｓｔｕａｒｉｅｓ", "The Pap​er Estuaries ", "Thе Рареr Еѕtuаrіеѕ", "THE PAPER EЅTUARIES"],
)
def test_one_artist_in_many_characters(shown):
    assert artist_key(shown) == "paper estuaries"


def test_accents_tell_artists_apart():
    assert artist_key("DJ Dorël 89") != artist_key("DJ Dorel 89")
    assert artist_key("DJ Dorël 89") == artist_key("DJ Dorël 89")


@pytest.mark.parametrize("name", ["Сумерки Северный", "Μελάνι Νερό", "½ ² ™ … №", "👩‍🚀", "☂️", "Pigeon Заря Dopa", ""])
def test_what_is_plain_stays(name):
    assert plain(name) == name


def test_script_of_a_word():
    assert plain("Рyчей") == "Ручей"
    assert plain("Gruklа'ѕ Signаl") == "Grukla's Signal"
    assert plain("ﬁeld") == "field"
    assert artist_key(None) is None and artist_key("  ") is None


@given(st.text(max_size=30))
def test_plain_is_settled(text):
    once = plain(text)
    assert plain(once) == once or not unicodedata.is_normalized("NFC", text)


SAME = ["Wait... Tifulu", "wait… tifulu", '"Wait... Tifulu"', "06 Wait... Tifulu", "Wait... Tifulu - 2016 Remaster", "Wait... Tifulu (feat. Koadroth Noagron)", "Wait... Tifulu feat. Someone", "Wait... Tifulu (Explicit)", "Wait... Tifulu [Remastered]", "Wait.. Tifullu", "Wait... Tiuflu"]


@pytest.mark.parametrize("title", SAME)
def test_spellings_of_a_recording(title):
    assert same_recording(recording_key(SAME[0]), recording_key(title))


@pytest.mark.parametrize("title", ["Wait... Tifulu (Live)", "Wait... Tifulu - Demo", "Wait... Tifulu ‐ Demo", "Wait... Tifulu (Brepom Remix)", "Wait... Tifulu, Pt. 2", "Wait... Tifulu II", "Wait... Tifulu (Acoustic) - Remastered 2010", "Wait... Other"])
def test_recordings_of_their_own(title):
    assert not same_recording(recording_key(SAME[0]), recording_key(title))


def test_parts_and_versions():
    assert recording_key("A Song ‐ Demo") == recording_key("A Song - Demo")
    assert same_recording(recording_key("X Song, Pt. 2"), recording_key("X Song II."))
    assert same_recording(recording_key("A Song (Live) (Remastered)"), recording_key("A Song (Live)"))
    assert not same_recording(recording_key("A Song II"), recording_key("A Song III"))
    assert recording_key(None) is None and recording_key(" ") is None


@given(st.text("abcd", min_size=4, max_size=8), st.integers(0, 7), st.sampled_from("xy"))
def test_one_slip(word, at, letter):
    at %= len(word)
    assert one_slip(word, word[:at] + letter + word[at:])
    assert one_slip(word, word[:at] + letter + word[at + 1 :])
    assert not one_slip(word, "zz" + word)
