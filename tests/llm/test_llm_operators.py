"""The ten operators on small tables with odd rows, against brute force and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import math
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("lodegrain.llm")

from lodegrain.llm import chat, common, exact_dedup, flac, langid, mixing, near_dedup, packing, queries, records, sharding, tokens, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, row string, sha string, part int, text_sha256 string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "s"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, near and exact copies."""
    base = prose(1, 120)
    texts = [None, "", "   ", "a", "A b", "one two three", base, base, base.upper(), base.replace(" ", "  "), base + " tail", prose(2, 4000), "é" * 3000, "日本語 テキスト です ね", "x" * 5000,
             "tab\tand\nline\x0b\x0cend\r", "\x1cfs\x1d \x85 \u00a0 \u2003 end  ", "don't  we'll   3 spaces"]
    texts += [" ".join(base.split()[:k] + ["edit"] + base.split()[k + 1 :]) for k in (3, 50, 90)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s10"][i % 4], i, i % 2 == 0, i, "r", "h", i, None) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "without id", "en", "s1", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# exact deduplication


@pytest.mark.parametrize("bits_per_row", [16, 1])
def test_exact_duplicates(docs, bits_per_row):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[hashlib.sha256(squeezed(r[1]).encode()).hexdigest()].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    got = exact_dedup.exact_duplicates(docs, bits_per_row=bits_per_row).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r["group_size"] == len(groups[r["text_sha256"]]) and r["keep_id"] == min(groups[r["text_sha256"]])[3]
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_keep_first_keeps_columns(docs, none):
    rows = exact_dedup.keep_first(docs)
    assert rows.columns == docs.columns
    assert sorted(squeezed(r["text"]) for r in rows.collect()) == sorted({squeezed(r[1]) for r in odd_rows()})
    assert exact_dedup.keep_first(none).count() == exact_dedup.exact_duplicates(none).count() == 0


def test_a_small_filter_is_used_in_ranges_and_changes_nothing(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 4000).cast("string").alias("text"))
    for most in (1 << 15, 1 << 20):
        assert exact_dedup.exact_duplicates(rows, max_bits=most).where("kept").count() == 4000
        assert exact_dedup.keep_first(rows, max_bits=most).count() == 4000


# sharding


def test_interleaved_shards(docs, none):
    got = sharding.interleaved_shards(docs, shards=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == len(odd_rows()) and set(by) == {0, 1, 2, 3}
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.interleaved_shards(none).count() == 0


def test_shards_match_the_mixture(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    share = sharding.interleaved_shards(rows, 10).groupBy("source", "shard").count().groupBy("source").agg(F.min("count").alias("a"), F.max("count").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] - r["a"] <= 2 and r["n"] == 10 for r in share)


# mixing


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 250 for s in target)  # rows that repeat at a cut are cut alike
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in odd_rows())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0


def test_mixed_documents_take_what_the_mix_says(docs):
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in rows.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# tokens, packing, records


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        found[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda name, text: found[name].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé.,'s 01\t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u200b\u0301日<|>endoftx-", max_size=40))
def test_ids_are_those_of_the_whole_text(plain, text):
    for name, layout in (("byte_bpe_50k.json", "joined"), ("word_bpe_49k.json", "dropped")):
        assert np.frombuffer(tokens.encoder(public_tokenizers.path(name), layout, 1000).ids(text), "<u4").tolist() == plain(name, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÀßÿ×÷ª$%^[]\\`{~'!/:@.,7\n s", max_size=60), min_size=1, max_size=4), st.sampled_from([0, 3, 40, 1000]))
def test_ids_with_marks_and_full_memos(plain, texts, memo_words):
    for name, layout in (("byte_bpe_50k.json", "joined"), ("word_bpe_49k.json", "dropped")):
        encode = tokens.encoder(public_tokenizers.path(name), layout, memo_words)
        for text in texts + texts:
            assert np.frombuffer(encode.ids(text), "<u4").tolist() == plain(name, text)
        assert len(encode.words) <= memo_words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "a", " ", "  ", ", é", "\n", "don't"]), max_size=9).map("".join))
def test_ids_of_texts_with_added_tokens(plain, text):
    for name, layout in (("byte_bpe_50k.json", "joined"), ("word_bpe_49k.json", "dropped")):
        assert np.frombuffer(tokens.encoder(public_tokenizers.path(name), layout, 1000).ids(text), "<u4").tolist() == plain(name, text)


def test_pack(docs, none, plain):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.cut_pieces(docs, path, "joined", 0, 256), 256).collect()
    ids = {r[0]: np.array(plain("byte_bpe_50k.json", r[1] or "") + [0], "<u4") for r in odd_rows() if r[0] is not None}
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            covered[r["doc_id"]].append((r["start"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    copies = defaultdict(int)
    for r in odd_rows():
        copies[r[0]] += 1
    for d, pieces in covered.items():
        assert sum(n for _, n in pieces) == copies[d] * len(ids[d])
    assert packing.pack(packing.cut_pieces(none, path, "joined", 0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
def test_cutting_patterns_cover_the_counts(counts):
    counts = np.array(counts)
    patterns = packing.cutting_patterns(counts)
    assert (sum((p * n for p, n in patterns), np.zeros(16, int)) == counts).all()
    assert all((p * np.arange(1, 17)).sum() <= 16 for p, _ in patterns)
    least = -(-int((counts * np.arange(1, 17)).sum()) // 16)
    assert sum(n for _, n in patterns) <= 1.3 * least + 17


def test_token_records(docs, none, plain):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = records.write_token_records(docs, path, "dropped", 1)
    got = sorted(records.read_token_records(manifest).collect(), key=lambda r: r["start"])
    at, last = 0, None
    texts = defaultdict(set)
    for r in odd_rows():
        texts[r[0]].add(tuple(plain("word_bpe_49k.json", r[1] or "") + [1]))
    for r in got:
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        found = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert found in texts[r["doc_id"]] and r["n_tokens"] == len(found) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at, last = at + len(found), r["doc_id"]
    assert len(got) == len(odd_rows())
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        records.write_token_records(docs, path, "dropped", 1, id_bytes=1)
    assert records.read_token_records(records.write_token_records(none, path, "dropped", 1)).count() == 0


def test_record_checksums():
    data = records.frame(b"payload")
    assert records.unframe(data) == b"payload"
    for i in range(len(data)):
        with pytest.raises((ValueError, struct.error)):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


# near deduplication


def shingles(text, n: int) -> frozenset:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple], n: int, percent: int) -> dict:
    sets, label = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, t): (len(sets[i]), least.get(find(i))) for i, (d, t) in enumerate(rows)}


def check_near(df, rows, n, percent):
    want = brute_components(rows, n, percent)
    got = near_dedup.near_duplicates(df, n, percent).collect()
    assert sorted((r["n_shingles"], r["component_id"] is None, r["component_id"] or 0) for r in got) == sorted((a, b is None, b or 0) for a, b in (want[r] for r in rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_with_odd_rows(docs, none):
    check_near(docs, [(r[0], r[1]) for r in odd_rows()], 4, 80)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_chains_and_hot_groups(spark):
    rng = random.Random(3)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(120):  # copies of one text with growing edits: many pairs next to the limit
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"a b c d e f g {i} h i j k l m {'n ' * (i % 3)}") for i in range(40)] + [(2000 + i, "same text of five words") for i in range(200)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 4, 80)


def similar_group(seed: int, n: int, edits: tuple[int, ...]) -> list[str]:
    """Texts of one base with as many edits each: alike, and below the limit to one another for 5 edits and more."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(150), edits[i % len(edits)]):
            w[k] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_candidates_of_a_group_below_the_limit_grow_with_its_size(spark, monkeypatch):
    counts, whole = [], near_dedup.compared

    def counting(pairs, *rest, **how):
        counts[-1] += pairs.count()
        return whole(pairs, *rest, **how)

    monkeypatch.setattr(near_dedup, "compared", counting)
    for n in (100, 200, 400):
        counts.append(0)
        rows = [(i, t) for i, t in enumerate(similar_group(n, n, (7, 9)))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert near_dedup.near_duplicates(df, 4, 80).where("not kept").count() == 0
    # of the 4,950, 19,900 and 79,800 pairs: the stars, at most one centre a band, and next to nothing beside them
    print(counts)
    assert counts[1] < 0.2 * 19_900 and counts[2] <= 3 * counts[1] <= 9 * counts[0]


def test_long_texts_below_the_limit_meet_nowhere(spark, monkeypatch):
    """Texts of 4,000 words, each with 3 % of a common text's words edited: what is compared is the stars, and grows with the group."""
    counts, whole = [], near_dedup.compared

    def counting(pairs, *rest, **how):
        counts[-1].append(pairs.count())
        return whole(pairs, *rest, **how)

    monkeypatch.setattr(near_dedup, "compared", counting)
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    for n in (50, 100, 200):
        counts.append([])
        texts = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(4000), 120):
                words[at] = f"edit{i}.{at}"
            texts.append((i, " ".join(words)))
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        assert near_dedup.near_duplicates(df, 4, 80).where("not kept").count() == 0
    # of 1,225, 4,950 and 19,900 pairs: one centre a band at most, and no pair beside the stars
    assert all(len(c) == 1 and c[0] <= 32 * n for c, n in zip(counts, (50, 100, 200))), counts
    assert counts[2][0] < 0.2 * 19_900


def test_members_similar_to_each_other_and_not_to_the_centre_are_linked(spark):
    """Pairs of texts that share edits of a common text: each pair is similar, its texts are not similar to any other."""
    rng = random.Random(13)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(400)], []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(400), 18):
            words[at] = f"both{i}.{at}"
        for j in range(2):
            own = list(words)
            for at in rng.sample(range(400), 3):
                own[at] = f"own{i}.{j}.{at}"
            rows.append((2 * i + j, " ".join(own)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 4, 80)


def test_buckets_miss_no_link_at_the_limit():
    """Sets of 20 to 450 with a similarity of 0.80 to 0.83: nearly every pair shares a bucket."""
    rng, missed, pairs = np.random.default_rng(4), 0, 0
    multipliers = near_dedup.tables()[3]
    bands = lambda x: (near_dedup.signature(np.unique(x)) * multipliers).reshape(-1, near_dedup.BAND_BINS)
    for _ in range(3000):
        both = int(rng.integers(20, 450))
        own = int(both * rng.uniform(0.205, 0.25) / 2)
        common, x, y = (rng.integers(0, 1 << 63, k, np.int64).view(np.uint64) * np.uint64(2) for k in (both, own, own))
        if 100 * both < 80 * (both + 2 * own):
            continue
        pairs += 1
        missed += not (bands(np.r_[common, x]) == bands(np.r_[common, y])).all(axis=1).any()
    assert pairs > 1000 and missed <= pairs // 1000


def test_near_duplicates_of_a_group_across_the_limit(spark):
    rows = [(i, t) for i, t in enumerate(similar_group(9, 90, (0, 1, 2, 3, 4, 5, 6)) + similar_group(10, 60, (3, 4)))]
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 4, 80)


def test_keep_one_of_each(docs):
    rows = near_dedup.keep_one_of_each(docs, 4, 80)
    assert sorted(rows.columns) == sorted(docs.columns)
    want = {b for (d, _), (_, b) in brute_components([(r[0], r[1]) for r in odd_rows()], 4, 80).items() if d is not None}
    assert {r["doc_id"] for r in rows.collect()} - {None} == want


def test_keep_one_of_each_with_clashing_and_missing_ids(spark):
    a, b = prose(11, 100), prose(12, 100)
    rows = [(1, a, 0), (5, a + " x", 1), (5, b, 2), (None, a, 3), (None, prose(13, 90), 4), (7, b, 5), (5, b, 6), (8, None, 7), (8, None, 8), (9, "w", 9), (9, "w", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)
    kept = near_dedup.keep_one_of_each(df, 4, 80).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, a), (5, b), (0, rows[4][1]), (8, ""), (8, ""), (9, "w")])


def test_bins_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 20, 400):
        agree = []
        for _ in range(60):
            common, extra = rng.integers(0, 1 << 63, (4 * n, 2)).astype(np.uint64)[:, 0], rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = np.unique(common), np.unique(np.concatenate([common, extra]))
            agree.append((near_dedup.signature(np.sort(near_dedup.stirred(a))) == near_dedup.signature(np.sort(near_dedup.stirred(b)))).mean())
        assert abs(np.mean(agree) - 0.8) < 0.06


# chat windows


def check_windows(windows, by, plain, budget, history):
    """Every window against loops over its conversation: whole turns in order, new ones once, history and system as defined."""
    count = lambda x: len(plain("byte_bpe_50k.json", x))
    new = defaultdict(list)
    for w in sorted(windows, key=lambda w: (w["conv_id"] is None, w["conv_id"] or 0, w["window"])):
        turns = [(chat.unescaped(m[1]), chat.unescaped(m[2])) for m in chat.TURN.finditer(w["text"])]
        sizes = [count(m[0][: m.start(2) - m.start()]) + count(m[2]) + count("</s>") for m in chat.TURN.finditer(w["text"])]
        whole = [(r, x) for _, r, x in by[w["conv_id"]]]
        at, n = w["window"], w["repeated"]
        system = bool(n) and turns[0] == whole[0] and whole[0][0] == "system"
        assert at == len(new[w["conv_id"]]) and turns[n:] == whole[at : at + len(turns) - n] and w["tokens"] == sum(sizes)
        assert turns[system:n] == whole[at - (n - system) : at] and sum(sizes[system:n]) <= history
        assert sum(sizes) <= budget or (len(turns) == n + 1 and n == system)
        assert at == 0 or whole[0][0] != "system" or system
        new[w["conv_id"]] += turns[n:]
        spans = [w["text"][s["start"] : s["start"] + s["length"]] for s in w["loss"]]
        assert [chat.unescaped(x) for x in spans] == [x for r, x in turns[n:] if r == "assistant"]
    assert {c: t for c, t in new.items()} == {c: [(r, x) for _, r, x in t] for c, t in by.items()}


def test_chat_windows(spark, plain):
    rng = random.Random(1)
    ok = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", ok), (-1, 1, "assistant", ok), (5, 0, None, None), (None, 0, "assistant", "x\\<s>\\"), (6, 0, "system", "be [kind]"), (6, None, "user", "first")]
    rows += [(7, t, ["user", "assistant"][t % 2], prose(t, rng.choice([1, 5, 200, 700]))) for t in range(40)]
    rows += [(8, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], "\\" * (t % 4) + "<s" * (t % 3) + "[INST]" * (t % 2) + prose(t, 30)) for t in range(30)] + [(9, 1, "user", "same"), (9, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.chat_windows(df, public_tokenizers.path("byte_bpe_50k.json"), budget=128, history=32)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    texts = [r["text"] for r in windows.where("conv_id = 8").collect()]
    assert len(texts) > 2 and all(t.startswith("<s>[INST] system [/INST]") for t in texts)
    check_windows(windows.collect(), by, plain, 128, 32)
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], df.schema), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>s/[]INST a", max_size=30))
def test_escaping_is_reversible(text):
    e = text.replace("\\", "\\\\")
    for mark in chat.CONTROL:
        e = e.replace(mark, mark[0] + "\\" + mark[1:])
    assert not any(m in e for m in chat.CONTROL) and chat.unescaped(e) == text


# archives


def test_archives(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nWARC-Type: x", "<p>x</p>"), (4, "é", None), (5, "u", ""), (None, "u", "solo"), (7, "u", "y" * 300_000), (7, "u", "y" * 300_000), (8, "u", "é\r\n\r\nz")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, records string").repartition(2)
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=400)).collect()
    keeper = {}
    for p, _, h in rows:
        keeper[h or ""] = max(p or -1, keeper.get(h or "", -1))
    want = []
    for p, _, h in rows:
        data, k = (h or "").encode(), keeper[h or ""]
        kind = "response" if k in (p, -1) else "revisit"
        want.append(str((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, k if kind == "revisit" else None)))
    assert sorted(want) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all(r["payload"].decode() in {h or "" for _, _, h in rows} for r in got if r["record_type"] == "response")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], pages.schema))).count() == 0
    assert warc.read_archives(warc.write_archives(pages, least_bytes=9)).where("record_type = 'revisit'").count() == 0


def test_zip64_directories():
    data = b"x" * 1000
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", data)
        z.writestr("b/ñ", b"second")
    whole = buffer.getvalue()
    read = lambda blob: lambda at, n: blob[at : at + n]
    assert warc.members(read(whole), len(whole))["b/ñ"][1] == 6
    # the same archive with a ZIP64 end record, locator and extra fields for what is marked as too large
    at = whole.rfind(struct.pack("<I", warc.END))
    start = struct.unpack_from("<I", whole, at + 16)[0]
    name = b"a"
    local = struct.unpack_from("<I", whole, start + 42)[0]
    entry = bytearray(whole[start : start + 46])
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, 28)
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    central = bytes(entry) + name + struct.pack("<HHQQQ", 1, 24, 1000, 1000, local)
    end64 = struct.pack("<IQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(central), start)
    blob = whole[:start] + central + end64 + struct.pack("<IIQI", warc.LOCATOR64, 0, start + len(central), 1)
    blob += struct.pack("<IHHHHIIH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    offset, size, method = warc.members(read(blob), len(blob))["a"]
    begin = warc.data_start(read(blob), offset)
    assert method == 0 and blob[begin : begin + size] == data
    with pytest.raises(ValueError):
        warc.members(read(b"no archive"), 10)


# media


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=64, max_size=64).map(lambda b: b * 3), st.binary(min_size=1, max_size=500), st.just(bytes(9000)), st.text(alphabet="abc é", min_size=80, max_size=300).map(str.encode)), min_size=1, max_size=5))
def test_flac_round_trip(payloads):
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    media = flac.encoded(payloads)
    back = [b"" for _ in media]
    for m, block, offset, pcm in flac.decoded(media):
        assert offset == len(back[m]) == block * flac.BLOCK
        back[m] += (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()
    assert back == payloads
    assert media == [flac.encoded([p])[0] for p in payloads]


def test_flac_damage_is_found():
    media = flac.encoded([prose(4, 900).encode().ljust(6400, b"\0")])[0]
    for at in (4 + 20, len(media) - 1, len(media) - 500, len(media) // 2):
        broken = media[:at] + bytes([media[at] ^ 4]) + media[at + 1 :]
        with pytest.raises((ValueError, IndexError)):
            list(flac.decoded([broken]))


def test_escaped_partitions_and_all_fixed_orders():
    rng = np.random.default_rng(1)
    for order in range(5):
        n, parts = 256, 2
        x = np.clip(np.cumsum(rng.integers(-2, 3, n)), -100, 100)
        residual = np.diff(x, order)
        bits = [flac.bit_array(np.array([(8 + order) << 1]), 8), flac.bit_array(x[:order], 8), flac.bit_array(np.array([parts]), 6)]
        at = 0
        for p in range(1 << parts):
            take = n // (1 << parts) - (order if p == 0 else 0)
            own, at = residual[at : at + take], at + take
            bits += [flac.bit_array(np.array([15]), 4), flac.bit_array(np.array([10]), 5), flac.bit_array(own, 10)] if p % 2 else [flac.bit_array(np.array([1]), 4), flac.rice_bits(own, 1)]
        assert (flac.decoded_frames([(np.packbits(np.concatenate(bits)).tobytes(), n)])[0] == x).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 36) - 1))
def test_frame_numbers(n):
    coded = flac.coded_number(n)
    assert flac.number_at(coded + b"\0", 0) == (n, len(coded))


def test_media_summary(docs, none):
    got = flac.media_summary(docs).collect()
    want = []
    for r in odd_rows():
        data = (r[1] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(want) == sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    assert len({r["payload_sha256"] for r in got}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got})
    assert flac.media_summary(none).count() == 0
    block = flac.decode_column(flac.encode_column(docs.where("doc_id = 11").select("doc_id", F.col("text").cast("binary").alias("bytes")))).where("sample_offset = 4096").first()
    assert (np.frombuffer(block["pcm"], np.uint8) ^ 128).tobytes().decode() == odd_rows()[11][1][4096:8192]


# languages


def test_language_id_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = F.col("doc_id") % 2 == 0
    rows = docs.withColumn("label", F.when(~held, F.col("lang")))
    got = langid.LanguageModel(rows, label="label", sample_rows=100).judged().join(docs.where(held), "doc_id")
    right, every = got.where("language = lang").count(), got.count()
    assert every and right >= 0.97 * every and got.where("not kept and text rlike '[a-z]'").count() <= 0.01 * every


def test_markup_suffix_and_host_move_the_verdict(spark):
    langs = {"en": "the of and that with", "fr": "les des que dans pour", "de": "der die und das ist"}
    rows = [(i, " ".join(random.Random(i).choices(langs[x].split(), k=30)), x, f"http://www.{x}-site{i % 5}.example.{x}/p") for i, x in enumerate(list(langs) * 60)]
    rows = [(i, f'<html lang="{x}">{t}', x, u) for i, t, x, u in rows] + [(900, '<html lang="fr">ok', None, "http://www.fr-site1.example.fr/q"), (901, "!!! 123", None, None), (902, None, None, None)]
    model = langid.LanguageModel(spark.createDataFrame(rows, "doc_id long, text string, lang string, url string"), address="url")
    got = {r["doc_id"]: r for r in model.judged().collect()}
    assert got[900]["language"] == "fr" and got[900]["markup"] == "fr" and got[900]["suffix"] == "fr"
    assert got[901]["language"] == got[902]["language"] == "und" and not got[901]["kept"] and not got[902]["kept"]
    assert all(got[i]["language"] == x for i, _, x, _ in rows[:180])


def brute_verdicts(model: langid.LanguageModel, rows: list[tuple]) -> list[tuple]:
    """(doc_id, language, confidence) of rows (doc_id, text, lang, url), by loops over the fusion's definition."""
    names, strength = model.languages, 20.0
    at = []
    for _, text, _, url in rows:
        text = text or ""
        host = None if url is None else (re.sub(r"^\w+://([^/]+).*", r"\1", url)).lower()
        labels = (host or "").split(".")
        tag = re.search(r"<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", text, re.I)
        t = langid.trigrams(text)
        ll = model.model[t].astype(float).sum(axis=0) / math.sqrt(1 + len(t) / 60) if re.search(r"[^\W\d_]", text) else None
        at.append({"ll": ll, "host": host, "domain": ".".join(labels[-2:]) if len(labels) > 1 else None, "suffix": labels[-1] if len(labels) > 1 else None,
                   "markup": tag[1].lower() if tag else None, "best": None if ll is None else int(ll.argmax())})
    n = len(names)
    whole = np.array([sum(r["best"] == i for r in at) for i in range(n)], float)
    count = lambda key, value: np.array([sum(r["best"] == i and r[key] == value for r in at) for i in range(n)], float)
    smooth = lambda c, onto: (c + strength * onto) / (c.sum() + strength)
    out = []
    for (doc_id, *_), r in zip(rows, at):
        if r["ll"] is None:
            out.append((doc_id, "und", 0.0))
            continue
        score, overall = r["ll"].copy(), (whole + 1) / (whole.sum() + n)
        if r["host"] is not None:
            onto = overall if r["domain"] is None else smooth(count("domain", r["domain"]), overall)
            score += np.log(smooth(count("host", r["host"]), onto))
        for key in ("markup", "suffix"):
            if r[key] is not None:
                score += np.log((count(key, r[key]) + 0.5) / (whole + 1))
        out.append((doc_id, names[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())))
    return out


def test_posterior_against_brute_force(spark):
    rng, rows = random.Random(4), []
    words_of = {"en": "the and house water with from".split(), "de": "der und haus wasser mit von".split(), "fr": "le et maison eau avec de".split()}
    for i in range(90):
        lang = rng.choice(list(words_of))
        text = " ".join(rng.choice(words_of[lang]) for _ in range(rng.choice([1, 2, 5, 40])))
        if i % 3 == 0:
            text = f'<html class="{"c" * 700}" lang="{lang}"> {text}'
        host = rng.choice([f"{lang}{i % 2}.site.{lang}", "mixed.example.org", "local"])
        rows.append((i, text, lang if i % 4 else None, rng.choice([f"https://{host}/{i}", host, None])))
    rows += [(900, "123 456", "en", "mixed.example.org"), (901, None, None, None)]
    model = langid.LanguageModel(spark.createDataFrame(rows, "doc_id long, text string, lang string, url string").repartition(3), address="url")
    got = {r["doc_id"]: r for r in model.judged().collect()}
    want = brute_verdicts(model, rows)
    assert any(r["markup"] for r in got.values()) and any(r["suffix"] for r in got.values())
    for doc_id, language, confidence in want:
        assert got[doc_id]["language"] == language and abs(got[doc_id]["confidence"] - confidence) < 1e-6, doc_id
        assert got[doc_id]["kept"] == (language != "und" and confidence >= 0.5)


def test_language_id_with_odd_rows(docs, none):
    model = langid.LanguageModel(docs)
    kept = model.in_known_language(docs)
    assert kept.columns == docs.columns and model.judged().count() == len(odd_rows())
    assert kept.count() == model.judged().where("kept").count()
    empty = langid.LanguageModel(none)
    assert empty.judged().count() == empty.in_known_language(none).count() == 0
    blind = langid.LanguageModel(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["language"] for r in blind.judged().collect()} == {"und"}


# shared


def test_placed(spark):
    rows = spark.createDataFrame([(i % 3, i, i) for i in range(50)], "a int, b int, v int").repartition(4)
    got = sorted(common.placed(rows, ["a", "b"], "v", rows_per_part=7).collect(), key=lambda r: r["place"])
    assert [(r["a"], r["b"]) for r in got] == sorted((i % 3, i) for i in range(50)) and [r["place"] for r in got] == list(range(50))
    total = 0
    for r in got:
        assert r["sum_before"] == total
        total += r["v"]


def test_pages_are_judged_by_text_markup_suffix_and_host(spark, tmp_path):
    LLM = queries.QUERIES  # noqa: N806
    langs = {"en": "the of and that with", "fr": "les des que dans pour", "de": "der die und das ist"}
    docs = [(i, " ".join(langs[x].split()[j % 5] for j in range(i, i + 30)), x) for i, x in enumerate(list(langs) * 40)]
    page = lambda x, body: f'<!DOCTYPE html><html lang="{x}"><style>p{{}}</style><script>var the = "and that"</script><p>{body}</p></html>'
    pages = [(i, f"http://www.{x}-site{i % 5}.example.{x}/p", page(x, t)) for i, t, x in docs] + [(900, "http://www.fr-site1.example.fr/q", page("fr", "ok")), (901, None, None), (902, "http://x.org", "<p>1 2</p>")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in LLM["op6_language_id_pages"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(got[i]["language"] == got[i]["markup"] == got[i]["suffix"] == x for i, _, x in docs)
    assert got[900]["language"] == "fr" and got[900]["kept"] and got[900]["host"] == "www.fr-site1.example.fr"
    assert got[901]["language"] == got[902]["language"] == "und" and not got[901]["kept"]


def test_no_language_or_value_is_left_out(spark):
    # 40 languages, and 10,100 suffixes of which each is met once; the last language is the rarest
    names = [f"l{i:02}" for i in range(40)]
    rows = [(i, " ".join(f"{x}{x[::-1]}{j}" for j in range(8)), x, f"www.a.s{i}") for i, x in enumerate([n for n in names for _ in range(3 if n == "l39" else 4)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    many = docs.unionByName(spark.range(10_100).selectExpr("id + 1000 doc_id", f"'{rows[0][1]}' text", "cast(null as string) lang", "'www.b.t' || id source"))
    for most in (320_000, 0):
        model = langid.LanguageModel(many, most_broadcast=most)
        got = {r["doc_id"]: r for r in model.judged().collect()}
        assert model.languages == names and len(got) == len(rows) + 10_100
        assert all(got[i]["language"] == x for i, _, x, _ in rows)
        assert model.tables[2].count() == len(rows) + 10_100


# the registered queries

#: The columns that each query returns.
COLUMNS = {
    "op1": "page_id payload_bytes payload_digest record_type refers_to", "op2": "doc_id size source_size target taken",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6": "doc_id language confidence kept",
    "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "doc_id n_shingles component_id kept",
    "op9": "doc_id keep_id group_size kept text_sha256", "op10": "doc_id start n_tokens ids_crc32",
    "op11": "item_id rank doc_id score", "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.fixture(scope="module")
def tables(spark, data):
    return {t: spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "pages", "conversations")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, data, tables, plain, name):
    got = queries.QUERIES[name](spark, data)
    number = name.split("_")[0]
    if name.endswith("_pages"):
        assert {r["page_id"] for r in got.collect()} == {r["page_id"] for r in tables["pages"]}
        return
    assert got.columns == COLUMNS[number].split()
    rows = got.collect()
    docs = {r["doc_id"]: r["text"] or "" for r in tables["documents"]}
    one = {r[0]: r for r in rows}
    if number in ("op2", "op4", "op5", "op6", "op8", "op9", "op10", "op12", "op13"):
        assert len(rows) == len(docs) and set(one) == set(docs)
    if number == "op1":
        assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in one.items()} == {r["page_id"]: (len((r["html"] or "").encode()), warc.digest((r["html"] or "").encode())) for r in tables["pages"]}
    elif number == "op2":
        assert all(r["size"] == len(words(docs[i])) and r["taken"] <= 2 * r["size"] for i, r in one.items())
    elif number == "op3":
        ids = {i: np.array(plain("byte_bpe_50k.json", t) + [0], "<u4") for i, t in docs.items()}
        assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
        assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) and len({r["sequence_id"] for r in rows}) * 1024 <= 1.1 * sum(map(len, ids.values())) + 1024
    elif number == "op4":
        counts = Counter(r["shard"] for r in rows)
        assert {r["law"] for r in rows} == {"rows"} and set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
        assert all(r["text_crc32"] == zlib.crc32(docs[i].encode()) for i, r in one.items())
    elif number == "op5":
        pad = lambda b: b + bytes(-len(b) % 64 or (0 if b else 64))
        assert all(r["payload_sha256"] == hashlib.sha256(pad(docs[i].encode())).hexdigest() for i, r in one.items())
    elif number == "op7":
        conversations = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
        for r in tables["conversations"]:
            conversations.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
        for c, turns in conversations.items():
            turns.sort()
            assert one[c]["n_turns"] == len(turns) and one[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert one[c]["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in turns if r == "assistant").encode()).hexdigest()
    elif number == "op8":
        want = brute_components(list(docs.items()), 4, 80)
        assert {(i, docs[i]): (r["n_shingles"], r["component_id"]) for i, r in one.items()} == want
    elif number == "op10":
        at = 0
        for i in sorted(docs):
            ids = np.array(plain("word_bpe_49k.json", docs[i]) + [1], "<u4")
            assert (one[i]["start"], one[i]["n_tokens"], one[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
