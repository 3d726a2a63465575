"""Lexical search, periodic runs and personal data on small tables with odd rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
pytest.importorskip("lodegrain.llm")

from lodegrain.llm import lexical, private_data, queries, repeats  # noqa: E402

SCHEMA = "doc_id long, text string, score long, rank int, item_id long, spans string, rid long, period long, start long, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, repeat=0):
    """Texts as documents with clashing further columns, some rows again, and a row without an id."""
    rows = [(i, t, 1, 2, 3, "s", 4, 5, 6, "w") for i, t in enumerate(texts)]
    rows += rows[:repeat] + [(None, "without an id the the the the the the the", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# search


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: term.findall((t or "").translate(lower))
    rows = [(i, Counter(tokens(t)), len(tokens(t))) for i, t in docs if tokens(t)]
    n_docs, length = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for i, counts, n in rows:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in tokens(text) if counts[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item_id, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bucket_rows, most_terms", [(1024, 200_000), (4, 200_000), (2, 6)])
def test_search_equals_brute_force(spark, bucket_rows, most_terms):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["Élan", "é", "ABC", "a-b", "日本"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30, 200]))) for _ in range(150)]
    texts += [None, "", " .,; ", "w1 " * 5000, texts[5], texts[5], texts[6].upper()]
    docs = table(spark, texts, repeat=4)
    asked = [(0, "w1 w2 W3 w1"), (1, texts[5]), (2, None), (3, "nowhere"), (4, "w7"), (4, "w8 élan É"), (5, "w9 w9"), (5, "w9 w9"), (None, "日本 abc"), (6, texts[7] + " x")]
    items = spark.createDataFrame([(i, t, "clash") for i, t in asked], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lexical.lexical_search(docs, items, k=10, bucket_rows=bucket_rows, most_terms=most_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got.collect(), brute_search(rows, asked, 10))


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.lexical_search(none, items).collect() == []
    assert lexical.lexical_search(table(spark, ["a", "a b"]), items.where("false")).collect() == []
    assert lexical.lexical_search(table(spark, ["", None]).where("doc_id is not null"), items).collect() == []


def test_bounds_prune_and_lose_nothing():
    """With the threshold of the best bucket, later buckets are skipped or thinned out, and the result stays."""
    rng = np.random.default_rng(1)
    item = lexical.Item({0: 1, 1: 2, 2: 1}, np.array([900, 500, 40, 10]))
    vectors = [(i, np.unique(rng.integers(0, 4, 3)), 1000 - i) for i in range(400)]
    exact = sorted(((-int(sum(item.weights[t] * x for t in terms if t < 3)), i) for i, terms, x in vectors))[:10]
    best = lexical.Best(10, 1)
    for low in range(0, 400, 50):
        part = vectors[low : low + 50]
        starts = np.cumsum([0, *(len(t) for _, t, _ in part)])
        terms = np.concatenate([t for _, t, _ in part])
        impacts = np.concatenate([np.full(len(t), x) for _, t, x in part])
        norms = np.array([x * len(t) ** 0.5 for _, t, x in part])
        lexical.search_bucket([item], [best], np.array([i for i, *_ in part]), norms, starts, terms, impacts)
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == exact
    assert best.floor == -exact[-1][0]


def test_search_sql(spark, duck, data):
    want = duck.execute(queries.ORACLES["op11_lexical_search"]).fetchall()
    same(queries.op11_lexical_search(spark, data).collect(), want)


# runs


def brute_runs(words, least=6, times=4):
    own, found, n = {}, {}, len(words)
    ids = np.array([own.setdefault(w, len(own)) for w in words] or [0])
    for q in range(1, n // times + 1):
        steps = np.diff(np.r_[0, (ids[:-q] == ids[q:]).astype(np.int8), 0])
        for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def brute_summary(text):
    words = WORD.findall(text or "")
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < b for a, b, q in runs)]
    top = min(((a - b, a, q) for a, b, q in runs), default=None)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return len(runs), *longest, sha(lines), sha(" ".join(kept))


def periodic(rng, n):
    """Words of few kinds with runs of many periods, side by side and inside each other."""
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += rng.choices("abcdefgh", k=rng.randrange(1, 30))
        else:
            motif = rng.choices("abcd", k=rng.choice([1, 1, 2, 3, 5, 8, 13, 40]))
            out += (motif * 60)[: int(len(motif) * rng.uniform(2, 20))]
            if rng.random() < 0.2:
                out += (out[-len(out) // 2 :]) * 4
    return " ".join(out)


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [periodic(rng, n) for n in [*range(1, 40), 100, 300, 1000, 3000]]
    texts += [None, "", " \t", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x " * 5000, ("x " * 7 + "y ") * 300, " ".join(map(str, range(3000))) + " ",
              (" ".join(map(str, range(700))) + " ") * 5, "\x1c \x85   é\n" * 8]
    docs = table(spark, texts, repeat=3)
    rows = docs.select("doc_id", "text").collect()
    got = repeats.run_summary(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((r.doc_id, *brute_summary(r.text)) for r in rows), key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=30).map(lambda x: x * 5))
def test_tiles_hold_every_run(words):
    own = {}
    ids = np.array([own.setdefault(w, len(own) + 1) for w in words], np.int32)
    covered = {}
    for k, cuts in repeats.possible_cuts(ids, 6):
        for cut in cuts.tolist():
            low = max(0, cut - repeats.REACH * (2 << k))
            tile = ids[low : cut + (repeats.REACH + 1) * (2 << k)].tolist()
            for p, a, b in repeats.fragments(tile, cut - low, low > 0, low + len(tile) < len(ids), k, 6, 4):
                covered.setdefault(p, set()).update(range(a + low, b + low))
                assert all(words[i] == words[i + p] for i in range(a + low, b + low - p))
    for a, b, q in brute_runs(words):
        assert set(range(a, b)) <= covered[q]


def test_runs_of_nothing_and_bounds(spark, none):
    assert repeats.run_summary(none).collect() == []
    with pytest.raises(ValueError):
        repeats.periodic_runs(none, times=3)


def test_fragments_of_a_long_run_move_as_few_rows(spark):
    """A run of 20,000 words is thousands of tiles and one fragment a task, not one a tile."""
    docs = spark.createDataFrame([(1, "x " * 20_000)], "doc_id long, text string").coalesce(1)
    rows = repeats.solve_tiles(repeats.explode_tiles(docs, "text", 6), 6, 4)
    assert rows.where("period = 1").count() == 1


def test_planted_periods(spark, data):
    """The query's texts repeat from word a on with period p, and the run is found."""
    docs = queries.table(spark, data, "documents")
    planted = {r.doc_id: r.text for r in queries.with_periods(docs).collect()}
    import zlib

    for r in docs.select("doc_id", "text").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            assert WORD.findall(planted[r.doc_id]) == words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        else:
            assert planted[r.doc_id] == r.text
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, data).collect()}
    assert got == {i: brute_summary(t) for i, t in planted.items()}


# personal data


def plain_base(text):
    dg = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0

    spans = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
             "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
             "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(dg(m[0])) <= 19 and luhn(dg(m[0]))],
             "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(dg(m[0])) <= 15]}
    return [(k, *s) for k, found in spans.items() for s in found]


SEARCHER = private_data.Searcher(40, 0.6, 0.3, 0.3)
TEXTS = [None, "", "mail a.b+c@x-y.co.uk, a@b, @c.d, a@b@c.de and a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 .1.2.3.4.", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "+49 (0) 30-123456 +1 +12 +123 +1.2.3 +999999999999999999", "4111111111111111111 +4111111111111111", "é 日本 x@y.zz ٣٤٥ +٣٤ 5500 0000 0000 0004",
         "IBAN DE89 3704 0044 0532 0130 00 to pay, GB82WEST12345698765432.", "IBAN DE88 3704 0044 0532 0130 00 is wrong", "amex card 3782 822463 10005 here", "order no 3782 822463 10005",
         "SSN 078-05-1120 and id 000-05-1120", "call (030) 123 4567 now", "a" * 200_000, "1" * 200_000, "1." * 50_000, "@" * 50_000, "a@" * 50_000, "+1 " * 30_000, "x@y." + "z" * 3000]


def test_base_spans_equal_plain_patterns(spark, none):
    docs = table(spark, TEXTS, repeat=3)
    rows = docs.select("doc_id", "text").collect()
    got = private_data.personal_data_summary(private_data.personal_data(docs)).collect()
    slow = re.compile(r"a{1000}|1{5000}")  # the plain patterns take quadratic time there, and find nothing in the first two
    want = []
    for r in rows:
        base = [] if slow.search(r.text or "") else plain_base(r.text or "")
        count = Counter(k for k, *_ in base)
        want.append((r.doc_id, *(count[k] for k in private_data.BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert private_data.personal_data_summary(private_data.personal_data(none)).collect() == []


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ09.@+-_%() 1é\n", max_size=60) | st.text(alphabet="0123456789 -+.", max_size=60))
def test_base_spans_of_any_text(text):
    assert [(k, a, b) for k, a, b, _, base in SEARCHER.spans(text) if base] == plain_base(text)


def further(text):
    return [(k, text[a:b]) for k, a, b, _, base in SEARCHER.spans(text) if not base]


def test_further_kinds_need_a_checksum_or_context():
    assert further(TEXTS[8]) == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert further(TEXTS[9]) == []
    assert further(TEXTS[10]) == [("card_short", "3782 822463 10005")] and further(TEXTS[11]) == []
    assert further(TEXTS[12]) == [("ssn", "078-05-1120")] and further("part 078-05-1120") == []
    assert further(TEXTS[13]) == [("phone_local", "(030) 123 4567")] and further("(030) 123 4567") == []


def test_scores_and_masked_text(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd or phone +49 30 123456" + " and" * 12 + ", version 1.2.3.4")], "doc_id long, text string")
    row = private_data.personal_data(docs, with_text=True).first()
    assert row.masked == "write to [EMAIL] or phone [PHONE]" + " and" * 12 + ", version [IP]"
    assert {s.kind: s.score for s in row.spans} == {"email": 1.0, "phone": 1.0, "ip": 0.3}


# exact deduplication by light keys


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 30])
def test_texts_that_occur_once_do_not_shuffle(spark, tmp_path, max_bits):
    """One bitmap or many, unmarked texts pass straight through: no exchange holds a text, and the kept rows are the same."""
    from lodegrain.llm import exact_dedup

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=12)), "x") for i in range(6000)] + [(7000 + i, f"copy {i % 50}" + " " * (i % 3), "y") for i in range(400)]
    rows += [(9000, "again", "z")] * 3 + [(None, None, None), (None, "", "e"), (9001, " ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = exact_dedup.keep_first(docs, max_bits=max_bits)
    groups = {}
    for i, t, c in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted((min(g)[3] for g in groups.values()), key=lambda x: (x is None, x or 0))
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == want
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # rows that are repeated whole, and nothing else
    assert "Union" in plan and plan.count("Exchange hashpartitioning") == 1


def test_light_rows_decide_without_texts(spark):
    from lodegrain.llm import exact_dedup

    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (2, "ab"), (3, "c")], "doc_id long, text string")
    groups = exact_dedup.repeated_texts(docs, "text", 16, 1 << 30)
    assert "text" not in groups.columns and [(r.keep_id, r.again) for r in groups.collect()] == [(1, False)]
