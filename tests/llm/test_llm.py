import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from segno.llm import runs as R
from segno.llm.bpe import Transducer, Utf8Decoder, decode, encode_corpus, read_ranks
from segno.llm.entities import _artist_fit, artist_heads, match_albums, propagate, title_key
from segno.llm.language import fit, language_stretches, page_languages, wrong_labels
from segno.llm.leaks import find_leaks, stream
from segno.llm.lookalike import disguised_names, plain_names
from segno.llm.pages import reading_order
from segno.llm.queries import QUERIES, VOCABULARY
from segno.llm.runs import collapse_runs, repeated_plays
from segno.llm.together import pair_counts, session_baskets
from segno.llm.top_n import top_artists_by_month, top_n
from segno.operators import plays as P

VOCAB = Path(VOCABULARY)


# runs -----------------------------------------------------------------------


def brute_runs(rows):
    """rows: (user, uts, track) without nulls, one artist, distinct times."""
    out = []
    for user in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == user)
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][0] - own[i - 1][0] > 1800 or own[i][1] != own[start][1]:
                if i - start > 1:
                    out.append((user, own[start][0], own[i - 1][0], i - start))
                start = i
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_runs_against_brute_force(spark, plays_of, artists_of, partitions, monkeypatch):
    rng = random.Random(partitions)
    times = rng.sample(range(0, 150_000), 300)
    rows = [("hot" if rng.random() < 0.7 else "u", t, rng.choice(["Alpha Tune", "Other Song"])) for t in times]
    monkeypatch.setattr(P, "in_order", lambda d, e, t, f=P.in_order: f(d, e, t, partitions=partitions))
    got = repeated_plays(plays_of([(u, t, "Ab", None, s) for u, t, s in rows]), artists_of("Ab"))
    assert sorted((r.username, r.first_uts, r.last_uts, r.n_plays) for r in got.collect()) == sorted(brute_runs(rows))


def test_run_rules(plays_of, artists_of):
    tune = "Alpha Tune"
    rows = [("u", 0, "Ab", None, tune), ("u", 0, "AB", None, "alpha tune"), ("u", 100, "The Ab", None, "03 Alpha Tume"), ("u", 200, "Ab", None, None), ("u", 300, "Ab", None, tune), ("u", 400, "Ab", None, tune + " (Live)"), ("u", 500, None, None, tune), ("u", None, "Ab", None, tune), ("u", 5000, "Ab", None, tune), ("u", 6800, "Ab", None, tune), ("u", 8601, "Ab", None, tune)]
    got = [(r.first_uts, r.last_uts, r.n_plays, r.duration) for r in repeated_plays(plays_of(rows), artists_of("Ab")).orderBy("first_uts").collect()]
    assert got == [(0, 100, 2, 100), (5000, 6800, 2, 1800)]
    assert repeated_plays(plays_of([]), artists_of("Ab")).count() == 0 and R.RUN[0] == "username" and collapse_runs is not None


# pairs ----------------------------------------------------------------------


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    baskets = [sorted({min(int(rng.expovariate(0.3)), 12) for _ in range(rng.randint(0, 6))}) for _ in range(400)]
    df = spark.createDataFrame([(b, 1) for b in baskets] + [(None, 1)], "items array<bigint>, n int").repartition(5)
    n, both = Counter(i for b in baskets for i in b), Counter((a, b) for s in baskets for k, a in enumerate(s) for b in s[k + 1 :])
    total = len(baskets) + 1
    want = {p: c for p, c in both.items() if c >= 3 and 500 * c >= total and c * total >= n[p[0]] * n[p[1]]}
    got = pair_counts(df, "items", 3, 500, 1).collect()
    assert {(r.a, r.b): r.n_ab for r in got} == want and all(abs(r.lift - r.n_ab * total / r.n_a / r.n_b) < 1e-9 for r in got)
    assert pair_counts(df.limit(0), "items", 3, 500, 1).count() == 0


def test_every_pair_has_its_counts(spark, plays_of, artists_of, tmp_path):
    # one session in common, and less often than by chance
    rows = [("u", 5000 * k, a, None, "t") for k, a in enumerate(["Ab"] * 3 + ["Cd"] * 3)] + [("v", 0, "Ab", None, "t"), ("v", 10, "Cd", None, "t")]
    plays_of(rows).write.parquet(str(tmp_path / "plays.parquet"))
    artists_of("Ab", "Cd").write.parquet(str(tmp_path / "artists.parquet"))
    got = [(r.artist_id_a, r.artist_id_b, r.n_ab, r.n_a, r.n_b, r.n_baskets, round(r.lift, 6)) for r in QUERIES["p2_pairs"](spark, str(tmp_path)).collect()]
    assert got == [(100, 101, 1, 4, 4, 7, 0.4375)]
    assert QUERIES["p2_found"](spark, str(tmp_path)).count() == 0


def test_baskets_hold_all_sessions(plays_of, artists_of):
    rows = [("u", 0, "Ab", None, "t"), ("u", 10, "Cd", None, None), ("u", 20, "ab", None, "t"), ("u", 5000, None, None, "t"), ("v", 0, "", None, "t"), (None, 0, "Ab", None, "t"), ("v", None, "Ab", None, "t")]
    got = sorted((r.username, r.start_uts, tuple(r["items"])) for r in session_baskets(plays_of(rows), artists_of("Ab", "Cd")).collect())
    assert got == [("u", 0, (100, 101)), ("u", 5000, ()), ("v", 0, ())]


# top n ----------------------------------------------------------------------


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaab") if rng.random() > 0.05 else None, i, rng.choice([None, 1, 2, 3]), rng.randint(0, 3)) for i in range(600)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [("a", None, 9, 9, "x")], "g string, item bigint, s1 bigint, s2 bigint, place string").repartition(7)
    groups = defaultdict(list)
    for g, i, a, b in rows:
        groups[g].append((-(a if a is not None else -(2**40)), -b, i))
    want = sorted((str(g), k, i) for g, v in groups.items() for k, (_, _, i) in enumerate(sorted(v)[:5], 1))
    assert sorted((str(r.g), r.place, r.item) for r in top_n(df, ["g"], ["s1", "s2"], "item", 5).collect()) == want
    assert top_n(df.limit(0), ["g"], ["s1"], "item", 5).count() == 0
    # whole numbers and null as groups; no group at all
    by = df.where("g IS NOT NULL").withColumn("g", (df["item"] % 3).cast("int")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    assert sorted((str(r.g), r.place) for r in top_n(by, ["g"], ["s1", "s2"], "item", 2).collect()) == [("1", 1), ("1", 2), ("2", 1), ("2", 2), ("None", 1), ("None", 2)]
    assert [(r.place, r.s1) for r in top_n(df.where("s1 IS NOT NULL"), [], ["s1"], "item", 2).collect()] == [(1, 3), (2, 3)]


def test_top_artists_by_month(plays_of, artists_of):
    rows = [("u", 100, "Ab", None, "Tune One"), ("u", 100, "AB", None, "tune one"), ("u", 200, "Cd", None, None), ("u", 200, "Cd", None, None), ("u", 300, "Ef", None, "x"), ("u", 40 * 86400, "Ef", None, "x"), ("u", 310, None, None, "x")]
    got = [(r.play_month, r.place, r.artist_id) for r in top_artists_by_month(plays_of(rows), artists_of("Ab", "Cd", "Ef")).orderBy("play_month", "place").collect()]
    assert got == [("1970-01", 1, 101), ("1970-01", 2, 102), ("1970-01", 3, 100), ("1970-02", 1, 102)]


# look-alikes ----------------------------------------------------------------


def test_disguised_names(spark, plays_of):
    album = "array<struct<artist:string,title:string,rank:int>>"
    plays = plays_of([("u", 1, a, None, None) for a in ("Plain Name", "Pаper", "Сумерки", None, "", "  ", " Ab", "Ａb", "½ ™", "A" * 50_000 + "​")])
    releases = spark.createDataFrame([(7, "Cafe\u0301"), (8, "Caf\u00e9"), (9, None)], "id bigint, artist_credit string")
    lists = spark.createDataFrame([(3, [("A", "Ok", 1), ("A", "ﬁx", 2), ("A", None, 3)]), (4, None)], f"list_id bigint, albums {album}")
    got = sorted((r.source_table, r.row_id, r.item_no) for r in disguised_names(plays, releases, lists).collect())
    assert got == [("critic_lists", 3, 2), ("plays", 2, 0), ("plays", 7, 0), ("plays", 8, 0), ("plays", 10, 0), ("releases", 7, 0)]
    assert plain_names(releases.limit(0), "artist_credit").count() == 0


# entities -------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b", "same"), [("The Keril Zage", "keril  zage (Deluxe Edition)", True), ("Keril Zage", "Keril Zage (Live)", False), ("Keril Zage II", "Keril Zage", False), ("Kepil & Befe: A Suite", "Kepil and Befe - A Suite", True), ("Mine (20th Anniversary Edition)", "Mine [LP]", True), ("Keril Zage (Remixes)", "Keril Zage Remixde", True), ("HarbÃ³ur", "Harbóur", True)])
def test_title_key(a, b, same):
    assert (title_key(a) == title_key(b)) == same


def test_match_albums(spark, artists_of):
    mention = [("plays", "The Ab Cdef", "Keril Zage"), ("plays", "Ab Cdef", "Kerl Zage"), ("plays", "Ab Cdef", "Keril Zage (Live)"), ("critic_lists", "Keril Zage", "Ab Cdef"), ("plays", "Other One", "Keril Zage"), ("plays", "Ab Cdef", "Keril Z..."), ("plays", "", "Keril Zage"), ("plays", None, "x"), ("plays", "Ab Cdef", "Keril Zage, Part 2")]
    releases = spark.createDataFrame([(1, "Ab Cdef", "Keril Zage", "x"), (2, "Ab Cdef feat. Some Body", "Keril Zage (Deluxe Edition)", "x"), (3, "Ab Cdef", "Keril Zage (Live)", "x"), (4, "Third One", "Keril Zage", "x"), (5, None, "Keril Zage", "x"), (6, "Ab Cdef", "", "x")], "id bigint, artist_credit string, title string, mention string")
    df = spark.createDataFrame(mention, "source_table string, artist string, title string")
    artists = artists_of("Ab Cdef", "Other One", "Third One", None)
    got = sorted((r.artist, r.title, r.release_id) for r in match_albums(df, releases, artists).collect())
    assert got == sorted([("The Ab Cdef", "Keril Zage", 1), ("The Ab Cdef", "Keril Zage", 2), ("Ab Cdef", "Kerl Zage", 1), ("Ab Cdef", "Kerl Zage", 2), ("Ab Cdef", "Keril Zage (Live)", 3), ("Keril Zage", "Ab Cdef", 1), ("Keril Zage", "Ab Cdef", 2), ("Ab Cdef", "Keril Z...", 1), ("Ab Cdef", "Keril Z...", 2)])
    assert match_albums(df.limit(0), releases, artists).count() == 0 and match_albums(df, releases.limit(0), artists).count() == 0


def test_artists_with_any_slip_share_a_head(spark, artists_of):
    rng = random.Random(8)
    for _ in range(4000):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 10)))
        i, c = rng.randrange(len(x)), rng.choice("abcd")
        for y in (x[:i] + x[i + 1 :], x[:i] + c + x[i:], x[:i] + c + x[i + 1 :], x[:i] + x[i : i + 2][::-1] + x[i + 2 :], x[:i] + " " + x[i:]):
            if _artist_fit([x], False, [y], False):
                assert set(artist_heads([x])) & set(artist_heads([y])), (x, y)
    releases = spark.createDataFrame([(1, "Hidden", "Keril Zage")], "id bigint, artist_credit string, title string")
    df = spark.createDataFrame([("plays", "Idden", "Keril Zage")], "source_table string, artist string, title string")
    assert [r.release_id for r in match_albums(df, releases, artists_of("Hidden")).collect()] == [1]


def test_titles_damaged_near_both_ends(spark, artists_of):
    whole = {"Sog\ufffdn Liri \ufffd\ufffd\ufffd": "Sogón Liri Abé", "caf\ufffd noir": "Café Noir", "\ufffdbc\ufffdef\ufffd": "Abcdefg", "A\ufffdC\ufffdE\ufffdG": "Abcdefg"}
    releases = spark.createDataFrame(list({(t, "Ab Cdef") for t in whole.values()} | {("Café Brun", "Ab Cdef")}), "title string, artist_credit string").selectExpr("xxhash64(title) AS id", "artist_credit", "title")
    df = spark.createDataFrame([("plays", "Ab Cdef", t) for t in whole], "source_table string, artist string, title string")
    got = match_albums(df, releases, artists_of("Ab Cdef")).join(releases.selectExpr("id AS release_id", "title AS album"), "release_id")
    assert sorted((r.title, r.album) for r in got.collect()) == sorted(whole.items())


def test_propagation_settles_rivals(spark):
    edges = spark.createDataFrame([(1, 10, "x", 180.0, 0.0), (2, 10, "y", 24.0, 12.0), (2, 11, "y", 24.0, 12.0), (3, 10, "z", 24.0, 12.0), (4, 10, "x", 180.0, 0.0), (5, 11, "v", 0.4, 0.2)], "l bigint, r bigint, spelling string, own double, variant double")
    got = {(r.l, r.r): r.confidence for r in propagate(edges, "l", "r").collect()}
    assert min(got[1, 10], got[4, 10]) > 0.9  # one spelling, no rivals
    assert got[2, 11] > 0.6 and got[2, 10] < 0.35  # 10 has its name already, so the near spelling is 11's
    assert got[3, 10] > 0.8  # nothing else to be: a misspelling
    assert got[5, 11] < 0.4
    assert propagate(edges.limit(0), "l", "r").count() == 0


def brute_beliefs(edges, near=1e-3):
    """Marginals of all edges, every one of which goes round until all are settled."""
    on, was, k = [1.0] * len(edges), [-1.0] * len(edges), 0
    while True:
        reach = [own * o + variant for (*_, own, variant), o in zip(edges, on)]
        total, claims = Counter(), {}
        for (left, *_), x in zip(edges, reach):
            total[left] += x
        for (left, right, spelling, own, _), o in zip(edges, on):
            mine = claims.setdefault(right, {})
            mine[spelling] = max(mine.get(spelling, 0.0), own / (1 + total[left] - own * o))
        free = [1 / (1 + sum(claims[right].values()) - claims[right][spelling]) for _, right, spelling, *_ in edges]
        now = [x / (1 + total[left]) for (left, *_), x in zip(edges, reach)]
        if max(abs(a - b) for a, b in zip(now, was)) < near:
            return {(left, right): c for (left, right, *_), c in zip(edges, now)}
        on, was, k = (free if k < 8 else [(a + b) / 2 for a, b in zip(free, on)]), now, k + 1


def test_only_contested_edges_go_round(spark, monkeypatch):
    from segno.llm import entities

    chain = [(f"m{i}", f"r{i + j}", f"s{i}", 8.0 + i, 4.0 * j) for i in range(4) for j in (0, 1)] + [("n", "r2", "s9", 24.0, 12.0)]
    calm = [(f"c{i}", f"a{i // 3}", f"t{i % 6}", 180.0 if i % 3 else 24.0, 0.0 if i % 3 else 12.0) for i in range(60)] + [("d1", "a0", "t1", 180.0, 0.0)]
    rows, real = [], entities.durable

    def durable(df):
        out = real(df)
        if "_was" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(entities, "durable", durable)
    edges = spark.createDataFrame(chain + calm, "l string, r string, spelling string, own double, variant double")
    got = {(r.l, r.r): r.confidence for r in propagate(edges, "l", "r").collect()}
    assert got == pytest.approx(brute_beliefs(chain + calm), abs=2e-3)
    assert len(rows) > 1 and set(rows) == {len(chain)}
    rows.clear()
    got = {(r.l, r.r): r.confidence for r in propagate(edges.where("l LIKE 'c%' OR l LIKE 'd%'"), "l", "r").collect()}
    assert got == pytest.approx(brute_beliefs(calm), abs=1e-9) and not rows


def test_propagation_decides_between_albums(spark, artists_of, caplog):
    # a slip from either album; one of them is heard under its own name
    releases = spark.createDataFrame([(1, "Ab Cdef", "Keril Zage"), (2, "Ab Cdef", "Keril Zago")], "id bigint, artist_credit string, title string")
    df = spark.createDataFrame([("plays", "Ab Cdef", "Keril Zage"), ("plays", "Ab Cdef", "Keril Zagu")], "source_table string, artist string, title string")
    artists = artists_of("Ab Cdef")
    assert sorted((r.title, r.release_id) for r in match_albums(df, releases, artists).collect()) == [("Keril Zage", 1), ("Keril Zagu", 2)]
    # alone, neither album is likelier than the other
    assert match_albums(df.where("title = 'Keril Zagu'"), releases, artists).count() == 0
    with caplog.at_level("WARNING"):
        assert match_albums(df, releases, artists, rounds=1).where("title = 'Keril Zagu'").count() == 0
    assert "not settled" in caplog.text


# tokenizer ------------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    if not VOCAB.exists():
        pytest.skip("no vocabulary on this machine")
    return Transducer(read_ranks(VOCAB.read_bytes()))


def reference(ranks):
    import tiktoken

    from segno.llm.bpe import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_against_library(machine):
    library, rng = reference(machine.ranks), random.Random(6)
    texts = ["", " ", "\n\n  x", "Hello's world  ", "lol" * 3000, "<|endoftext|>", "漢字 😀é"]
    texts += ["".join(rng.choice("abcdefgh  \n\t'sé漢字😀½²₤12З.-") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in texts:
        ids = machine.encode(t)
        assert ids == library.encode_ordinary(t)
        assert "".join(decode(ids, machine.token)) == t


def test_transducer_on_another_vocabulary():
    path = VOCAB.with_name("byte_bpe_multi_50k.tiktoken")
    if not path.exists():
        pytest.skip("no vocabulary on this machine")
    m, rng = Transducer(read_ranks(path.read_bytes())), random.Random(8)
    syllables = ["ta", "sko", "bre", "mi", "ück", "ная", "ção", "ing", "'s", "th", "e", "漢"]
    for _ in range(1500):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
        assert list(m.encode_word(w)) == m.merge(w.encode())


def test_utf8_machine():
    rng = random.Random(9)
    for _ in range(300):
        data = bytes(rng.choice([rng.randrange(256), 0x41, 0xE2, 0x82, 0xAC]) for _ in range(rng.randint(0, 9)))
        d, out, at = Utf8Decoder(), "", 0
        while at < len(data):
            n = rng.randint(1, 3)
            out, at = out + d.feed(data[at : at + n]), at + n
        assert out + d.end() == data.decode("utf-8", "replace")


def test_encode_corpus(spark, machine):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (5, "long " * 50_000, "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, str(VOCAB)).collect()}
    library = reference(machine.ranks)
    assert got[1] == library.encode_ordinary("Hello world") and got[2] == [] and got[3] == [] and got[None] == library.encode_ordinary("a") and got[5] == library.encode_ordinary("long " * 50_000)
    assert encode_corpus(df.limit(0), str(VOCAB)).count() == 0


# pages ----------------------------------------------------------------------

ITEM = "There were 854 persons at Dodrustadheim last night, and Lina Graprosezberg thanked the parish council from Driskeckona for their help. Nothing more has been heard of Mara Saethatecvalley since the harbour board from Woekthorpville left Trobothstad with the church roof of Sogelonberg."
LINES = "array<struct<x0:int,y0:int>>"


def boxes(text, x=100):
    return [(x, 100 + 30 * k) for k, _ in enumerate(text.split("\n"))]


def test_reading_order():
    assert reading_order("a1\nb1\na2\nb2", [100, 500, 102, 503], [10, 12, 40, 42]) == ["a1", "a2", "b1", "b2"]
    assert reading_order("a\nb", None, None) == ["a", "b"] and reading_order("a\nb", [1], [1]) == ["a", "b"] and reading_order("a\nb", [1, None], [1, 2]) == ["a", "b"]


def test_leaks(spark):
    words = ITEM.split()
    broken = " ".join(words[2:22]).replace("persons", "pcrsons").replace("Graprosezberg", "Grap-\nrosezberg").replace("thanked", "tlianked")
    advert = " ".join(words[4:12]) + "\nBest boots in town! Apply within, 12 pence.\n" + " ".join(words[12:26])
    two = [f"{a}\n{b}" for a, b in zip([" ".join(words[i : i + 4]) for i in range(0, 32, 4)], ["filler text of another column"] * 8)]
    docs = {1: ITEM, 2: broken, 3: " ".join(words[:10]), 4: "Some words about Dodrustadheim and Lina Graprosezberg alone, nothing more of it here", 5: ITEM.upper() + " tail" * 5000, 6: advert, 7: "\n".join(two), 8: "", 9: None}
    cross = [(100 + 400 * (k % 2), 100 + 30 * (k // 2)) for k in range(16)]
    rows = [(i, t, cross if i == 7 else boxes(t) if t else None, "x") for i, t in docs.items()]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, page_lines {LINES}, item_id string")
    items = spark.createDataFrame([(77, ITEM, "x"), (78, "too short", "x"), (79, None, "x"), (None, ITEM, "x")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_words for r in find_leaks(df, items).collect()}
    assert set(got) == {(1, 77), (2, 77), (5, 77), (6, 77), (7, 77)} and got[1, 77] == len(words)
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
    assert stream("Fae-skogamez, 1t") == stream("faeskogamez It")


def test_leaks_need_the_same_figures_and_names(spark):
    item = "The fire at Sorosby began near Stemund Silerini's stable and burnt 644 sacks of corn, but the new magistrate from Donathona was unhurt by it."
    words = item.split()
    texts = {
        1: " ".join(words[:13]) + " hay",  # 13 words
        2: item.replace("644", "645"),
        3: item.replace("644", "1644"),
        4: " ".join(item.replace("Silerini", "Gakuwoth").split()[:19]),
        5: item.replace("Donathona", "Dcnathoua").replace("Silerini", "Sileriui").replace("burnt", "bur.t").replace("644", "6\u200b44"),
        6: item.replace("644 sacks", "64 4sacks"),
        7: item.replace("burnt 644 sacks of corn", "burnt\n" + "\n".join("An advert that goes on for many lines, 12 pence." for _ in range(40)) + "\n644 sacks of corn"),
        8: item.replace("a", "o", 1).replace("the new", "tlie ncw"),
        9: item.replace("644", "b44"),
    }
    df = spark.createDataFrame([(i, "Some words go before it.\n" + t + "\nAnd some behind.") for i, t in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.n_words for r in find_leaks(df, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()}
    assert got == {5: 25, 6: 25, 7: 25, 8: 25, 9: 25}, got
    at = words.index("644")
    short, n = " ".join(words[at:]), len(words) - at
    items = spark.createDataFrame([(5, short)], "item_id bigint, text string")
    pages = spark.createDataFrame([(1, "burnt 1" + short), (2, "burnt " + short)], "doc_id bigint, text string")
    assert [r.doc_id for r in find_leaks(pages, items, n).collect()] == [2]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr("segno.llm.leaks.BLOCK_LETTERS", 100)
    items = spark.createDataFrame([(k, ITEM + f" Word{k}") for k in range(3)], "item_id bigint, text string")
    df = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert sorted(r.item_id for r in find_leaks(df, items).collect()) == [0, 1, 2]


EN = "the harbour board had never seen the old stone bridge and the night watchman thanked them for their help last night\nnothing more has been heard of the widow since she left with the evening train before the end of the month"
DE = "der alte Lehrer hat von dem Hafenmeister nichts mehr gehört und wurde gefragt ob die Arbeiter bis zum Winter fertig würden\ndas Feuer brach im Stall aus und verbrannte alle Säcke Korn aber die Feuerwehr blieb unverletzt und dankte allen"


def test_languages(spark):
    rng = random.Random(2)

    def page(text):
        words = text.replace("\n", " ").split()
        return "\n".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(12))

    rows = [(i, page(EN if i % 2 else DE), ["de", "en"][i % 2]) for i in range(60)]
    rows += [(100, page(EN), "de"), (101, page(DE), None), (102, page(EN), "English"), (103, page(DE), "deu"), (104, page(EN) + "\n" + page(DE), "en"), (105, page(EN), "und"), (106, "12 34\n56 7/8", None), (107, "", None), (108, None, None), (109, "the old bridge", None), (110, page(EN) + "\nder alte Lehrer", "en-GB")]
    df = spark.createDataFrame([(i, t, la, boxes(t) if t else None, "x") for i, t, la in rows], f"doc_id bigint, text string, lang string, page_lines {LINES}, label string")
    stretches = language_stretches(df, fit(df, 20)).cache()
    got = sorted((r.doc_id, r.lang) for r in wrong_labels(page_languages(stretches)).collect())
    assert got == [(100, "en"), (101, "de"), (104, "de"), (104, "en"), (105, "en")]
    assert all(0 < r.confidence <= 1 for r in stretches.collect()) and stretches.where("doc_id >= 106 AND doc_id < 109").count() == 0
    assert language_stretches(df, fit(df.limit(0))).count() == 0 and np.isfinite(stretches.count())
