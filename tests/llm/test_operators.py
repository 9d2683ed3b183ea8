"""The text operators on awkward small tables, against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moundworks.llm import bpe, chat, language_id, licenses, media, mixing, near_dedup, quality_rules, substring, warc
from moundworks.llm.common import Scratch, clear, scratch_dir
from moundworks.llm.queries import vocabulary_path

RNG = random.Random(5)
VOCABULARY = [f"w{i}é" for i in range(400)]
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(3000))
PASSAGE = " ".join(RNG.choice(VOCABULARY) for _ in range(60))
TEXTS = {
    1: None, 2: "", 3: " \t\n ", 4: "one", 5: LONG, 6: LONG, 7: LONG.replace("w7é", "x", 1), 8: f"a b {PASSAGE} c", 9: f"{PASSAGE} d e f", 10: "x y z " * 40,
    11: "###\n$$ || some words here are few but enough for us\n###\n", 12: "All Rights Reserved. cc by cc-by GNU General  Public License", 13: "🙂".encode("utf-16", "surrogatepass").decode("utf-16"),
}
WORDS = {i: (t or "").encode().split() for i, t in TEXTS.items()}


@pytest.fixture(scope="module")
def docs(spark):
    """With an extra column and one whose name clashes with an operator's own."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", len(t or ""), "x", i) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, comp int").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge(spark, docs, labels))
    for i, words in WORDS.items():
        w = [x.decode() for x in words]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and got[i].kept != got[i].base_failed
    assert got[11].n_symbols == 10 and got[11].n_dup_lines == 1
    assert quality_rules.judge(spark, docs.limit(0), labels.limit(0)).count() == 0
    kept = quality_rules.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(k, n) for n in (1, 50, 400, 2000) for k in (0, 1, 3, n // 60) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    for k, n, got in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        want = 1.0 if k >= n * 0.02 else sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_promise(spark):
    rows = [(i, False, 1, float(i % 100 == 0) * 30 + float(i % 2) * 0.5, 0.0, 0.0) for i in range(4000)]
    scored = spark.createDataFrame(rows, "doc_id long, base_failed boolean, stratum int, symbol_pct double, dup_line_pct double, repeat_pct double")
    labels = scored.select("doc_id", F.lit(1).alias("quality"))
    cut = quality_rules.fit_cutoffs(scored, labels).collect()[0]
    assert cut.symbol_pct_cutoff == 2.0 and cut.repeat_pct_cutoff == 2.0  # one in a hundred is lost at most, under two
    assert quality_rules.fit_cutoffs(scored, labels.limit(20)).count() == 0


def binomial_tail(k, n, p):
    from math import comb

    return 1.0 if k >= n * p else sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_quality_rules_reject_by_hand_made_cutoffs(spark):
    """Enough labels that every rule has a cutoff: judge and keep_good against the method in plain Python."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 100]))]
        kind = rng.randrange(4) if i % 10 == 0 else 3
        lines = [" ".join(words[k : k + 10]) for k in range(0, len(words), 10)]
        if kind == 0:
            words = ["##$$" if rng.random() < 0.7 else w for w in words]
            lines = [" ".join(words)]
        if kind == 1:
            lines += [lines[0]] * 3 if len(lines) < 5 else [lines[0]]
        if kind == 2:
            lines = [" ".join([*words, *words[: max(5, len(words) // 20)]])]
        rows.append((i if i else None, "\n".join(lines), "x"))
        if rng.random() < 0.9:
            labels.append((i, int(kind == 3), 0))
            if i % 50 == 0:
                labels.append((i, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, signal string")
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(spark, df, lab).collect()
    good = {d for d, q, _ in labels if q == 1} - {d for d, q, _ in labels if q == 0}
    want = {}
    for stratum in range(4):
        held = [r for r in got if r.stratum == stratum and not r.base_failed and r.doc_id in good]
        for rule, cutoffs in quality_rules.RULES.items():
            for c in cutoffs:
                if not held or binomial_tail(sum(r[rule] > c for r in held), len(held), quality_rules.ALPHA) > quality_rules.DELTA / 12:
                    break
                want[stratum, rule] = c
    assert {rule for _, rule in want} == set(quality_rules.RULES)
    for r in got:
        hits = [rule for rule in quality_rules.RULES if r[rule] > want.get((r.stratum, rule), 1e9)]
        assert r.kept == (not r.base_failed and not hits) and all(r[f"{rule}_cutoff"] == want.get((r.stratum, rule)) for rule in quality_rules.RULES)
    rejected = [r.doc_id for r in got if not r.kept and not r.base_failed]
    assert len(rejected) > 50
    kept = quality_rules.keep_good(spark, df, lab)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.kept)
    assert quality_rules.keep_good(spark, df.limit(0), lab).count() == 0


def test_bpe(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    own, public = bpe.load(path), tokenizers.Tokenizer.from_file(path)
    for t in [*TEXTS.values(), "<|endoftext|>a <|endoftext|>", "a\x1c b\u0085c d  e", "it's WE'LL 123 ½", "\x00\x7f"]:
        ids = public.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t or "") == ids and own.decode(ids) == public.decode(ids, skip_special_tokens=False)
    got = by_id(bpe.encode_table(spark, docs, path))
    ids = public.encode(TEXTS[8], add_special_tokens=False).ids
    assert got[8].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[1].n_tokens == 0 and len(got) == len(TEXTS)


def test_bpe_keeps_ids_and_text(spark, docs):
    path = vocabulary_path()
    own, got, told = bpe.load(path), by_id(bpe.encode_rows(spark, docs, path)), by_id(bpe.encode_table(spark, docs, path))
    for i, t in TEXTS.items():
        ids = np.frombuffer(got[i].ids, "<u4")
        assert ids.tolist() == own.encode(t or "") and got[i].n_tokens == len(ids) and got[i].decoded == (t or "")
        assert told[i].ids_sha256 == hashlib.sha256(got[i].ids).hexdigest() and told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_table_equals_the_library_on_every_document(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    public, df = tokenizers.Tokenizer.from_file(path), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = "ab cd\n" * 35_000 + "é" * 5_000 + "x" * 20_000  # 235,000 characters, one piece of 20,000
    df = df.select("doc_id", "text").union(spark.createDataFrame([(-1, long), (None, "a"), (-1, "again")], "doc_id long, text string")).withColumn("ids", F.lit("mine"))
    texts = sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    want = []
    for i, t in texts:
        ids = public.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode_table(spark, df, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "a", "lstrip": True}]}, {"decoder": None}])
def test_bpe_refuses_other_files(change):
    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    with pytest.raises(ValueError):
        bpe.check(spec | change)


def test_bpe_memory_of_pieces_is_bounded(monkeypatch):
    own = bpe.load(vocabulary_path())
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    for i in range(2_000):
        own.encode(f" piece{i} {'y' * (i % 200)}")
        assert sum(len(k) + len(v) for k, v in own.known.items()) <= 5_000 and max(map(len, own.known)) <= bpe.LONGEST


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    own = bpe.load(vocabulary_path())
    assert own.decode(own.encode(text)) == text


def test_near_dedup(spark, docs):
    got = by_id(near_dedup.groups(spark, docs))
    assert {i: r.component_id for i, r in got.items()} == {**{i: i for i in TEXTS}, 6: 5, 7: 5, 9: 8}  # 8 and 9 share 59 of 65 shingles
    assert got[1].n_shingles == 0 and got[4].n_shingles == 1 and got[10].n_shingles == 3
    assert near_dedup.groups(spark, docs.limit(0)).count() == 0
    kept = near_dedup.keep_one(spark, docs.union(docs.filter("doc_id = 4")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in TEXTS if i not in (6, 7, 9)]


def test_near_dedup_links_through_members_that_are_no_centre(spark):
    rng, base, rows = random.Random(2), [f"b{i}" for i in range(120)], []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), 7 if i != 30 else 0):
            words[k] = f"n{i}_{k}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(near_dedup.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == root


def test_near_dedup_of_another_width(spark):
    words = VOCABULARY[:100]
    changed = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(words)]  # two-word sets share 89 of 109, five-word sets 71 of 121
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words)), (4, "a b c")], "doc_id long, text string")
    assert len({tuple(words[i : i + 5]) for i in range(96)} & {tuple(changed[i : i + 5]) for i in range(96)}) == 71
    assert {r.doc_id: r.component_id for r in near_dedup.groups(spark, df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    five = by_id(near_dedup.groups(spark, df, width=5))
    assert {i: (r.component_id, r.n_shingles) for i, r in five.items()} == {1: (1, 96), 2: (2, 96), 3: (1, 96), 4: (4, 1)}
    assert {r.doc_id for r in near_dedup.keep_one(spark, df, 5).collect()} == {1, 2, 4}


def repeated(words_by_key):
    seen = Counter(tuple(w[k : k + 35]) for w in words_by_key.values() for k in range(len(w) - 34))
    return {i: [any(seen[tuple(w[k : k + 35])] > 1 for k in range(max(0, p - 34), min(p, len(w) - 35) + 1)) for p in range(len(w))] for i, w in words_by_key.items()}


def test_substring(spark, docs):
    gone = repeated(WORDS)
    got = by_id(substring.dedup(spark, docs))
    for i, w in WORDS.items():
        kept = b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone[i]), hashlib.sha256(kept).hexdigest())
    assert substring.dedup(spark, docs.limit(0)).count() == 0
    left = by_id(substring.without_repeats(spark, docs))
    assert left[8].text.split() == ["a", "b", "c"] and 6 not in left and left[8].size == "x" and left[8].n_chars == len(left[8].text)


def test_substring_of_a_passage_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_PIECES", 3)
    rng = random.Random(9)
    words = {i: [*(f"p{rng.randrange(99)}" for _ in range(5 + i % 7)), *PASSAGE.split(), *(f"q{rng.randrange(99)}" for _ in range(4 + i % 5))] for i in range(40)}
    got = by_id(substring.dedup(spark, spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")))
    assert {i: got[i].n_removed for i in got} == {i: sum(g) for i, g in repeated(words).items()}


def test_substring_of_null_and_repeated_ids(spark):
    """Null ids, two texts of one id, a row that stands twice, a text of 2 MB; clashing column names."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    long = [f"v{i}" for i in range(250_000)]
    rows = [(None, [*a, "x"]), (None, ["y", *a]), (7, [*b, "z"]), (7, ["q", *b, *c]), (9, [*c, "k"]), (9, [*c, "k"]), (3, long), (4, ["m", *long[1000:1200]]), (None, None)]
    df = spark.createDataFrame([(i, None if w is None else " ".join(w), "mine") for i, w in rows], "doc_id long, text string, k string")
    gone = repeated({i: [x.encode() for x in w or []] for i, (_, w) in enumerate(rows)})
    want = sorted((i or 0, len(w or []), sum(gone[n])) for n, (i, w) in enumerate(rows))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.dedup(spark, df).collect()) == want
    kept = [(i or 0, " ".join(x for x, g in zip(w, gone[n], strict=True) if not g)) for n, (i, w) in enumerate(rows) if w and not all(gone[n])]
    left = substring.without_repeats(spark, df).collect()
    assert sorted((r.doc_id or 0, " ".join(r.text.split())) for r in left if r.text) == sorted(kept) and sum(r.text is None for r in left) == 1 and {r.k for r in left} == {"mine"}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
def test_automaton_counts_windows(sequences):
    a = substring.SuffixAutomaton(sequences, [1] * len(sequences))
    for size in (1, 3):
        seen = Counter(tuple(s[k : k + size]) for s in sequences for k in range(len(s) - size + 1))
        for s in sequences:
            assert [n for _, n in a.windows(s, size)] == [seen[tuple(s[k : k + size])] for k in range(len(s) - size + 1)]


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), None if i % 9 == 0 else f"s{i % 4}") for i in range(900)] + [(5, "w w", "s1"), (1000, None, "s1"), (1001, "", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(spark, df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for s in {r.source for r in got} - {"s9"}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and own[0].source_size == sum(r.size for r in own)
    again = mixing.mix(spark, df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copy_no, r.taken) for r in got) == sorted((r.doc_id, r.copy_no, r.taken) for r in again)
    assert mixing.targets([("a", 100), ("b", 10), (None, 10)]) == {"a": 75.0, "b": 30.0, None: 15.0}
    assert mixing.targets([("a", 10), ("b", 100), (None, 10)]) == {"a": 30.0, "b": pytest.approx(60), None: 30.0}
    out = mixing.apply_mix(spark, df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, df.limit(0)).count() == 0


def test_mixing_keeps_rows_of_null_or_repeated_id(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (None, "c d e", None), (2**60 + 1, "x", "s"), (2**60 + 1, "y y", "s"), (3, None, "t")] + [(i, "w " * (i % 7 + 1), "t") for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("mine"))
    got = mixing.mix(spark, df).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 3 and sum(r.doc_id == 2**60 + 1 for r in got) == 2
    out = mixing.apply_mix(spark, df)
    taken = Counter((r.doc_id, r.source) for r in got for _ in range(r.copies))
    assert out.columns == df.columns and Counter((r.doc_id, r.source) for r in out.collect()) == taken
    assert mixing.apply_mix(spark, df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12))
def test_target_levels_equal_the_plain_form(spark, words):
    named = [(None if i == 3 else f"s{i:02d}", n) for i, n in enumerate(words)]
    with Scratch(spark) as scratch:
        table = mixing.target_table(scratch, spark.createDataFrame([(s, n, 1) for s, n in named], "source string, words long, n long")).collect()
    plain = mixing.targets(named)
    assert {r.source: pytest.approx(r.target, rel=1e-9, abs=1e-9) for r in table} == plain


@pytest.mark.parametrize("sizes", [[60, 40, 50, 30, 30, 20, 20, 10, 10, 10], [900, 400, 50, 30, 30, 20, 20, 10, 10, 10], [5, 5, 5, 3, 3]])
def test_settling_keeps_every_probability(sizes):
    """Over many seeds each row, of the reserve or not, is taken as often as its probability says, also where one document
    outweighs the reserve; where none does, the words end within one row of the reserve."""
    n, held = 4000, [i > 2 for i in range(len(sizes))]
    for p in (0.2, 0.5, 0.85):
        got = np.array([mixing.settle(list(range(len(sizes))), sizes, [p] * len(sizes), held, seed) for seed in range(n)])
        assert np.abs(got.mean(axis=0) - p).max() < 4.5 * np.sqrt(p * (1 - p) / n)
        if sizes[0] == 60 and p == 0.5:
            assert np.abs(got @ np.array(sizes) - p * sum(sizes)).max() <= 30


def test_pivotal_tree_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.createDataFrame([(i, " ".join(["w"] * (i % 50)), f"s{i % 2}") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(spark, df).collect()
    assert len(got) == 1000
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0, 1)), max_size=20))
def test_pivotal_keeps_mass(rows):
    sizes, p = [r[0] for r in rows], [r[1] for r in rows]
    out = mixing.pivotal(list(range(len(p))), sizes, p, 1)
    assert sum(a * b for a, b in zip(out, sizes, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, sizes, strict=True)), abs=1e-4)
    assert sum(x not in (0, 1) for x in out) <= 1


CONTROL = ["### ", "</turn>", "</turn>\n", "\\", "\\s", "\\h", "#", "<", "\n", "a", "### Assistant: ", ""]


def test_chat(spark):
    rng, rows = random.Random(1), []
    for c in range(80):
        rows += [(c, t, rng.choice(["user", "assistant", "Tool: x", "", None, "a\\c]</turn>"]), rng.choice([None, "".join(rng.choice(CONTROL) for _ in range(6))])) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in range(80):
        turns = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert "\\h" in chat.format_chats(chat.planted(spark)).collect()[0].formatted
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_warc(spark):
    html = {1: "p" * 200, 2: "p" * 200, 3: "p" * 50, 4: "p" * 50, 5: None, 6: "é" * 60, 7: "p" * 200}
    df = spark.createDataFrame([(i, None if i == 4 else f"http://b{i % 2}.example.com/x\r\ny?q={i}", h, 1) for i, h in html.items()], "page_id long, url string, html string, first int")
    got = {r.page_id: r for r in warc.histories(spark, df).collect()}
    for i, h in html.items():
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i in (2, 7) else ("response", None))
    order = sorted(got.values(), key=lambda r: (r.range_no, r.range_place))
    assert [(r.url_key, r.captured) for r in order] == sorted((r.url_key, r.captured) for r in order)
    assert warc.histories(spark, df.limit(0)).count() == 0


def test_warc_of_repeated_and_null_pages(spark):
    rows = [(1, "http://a.b/x", "p" * 200), (1, "http://a.b/x", "p" * 200), (2, "http://a.b/x", "p" * 200), (None, "http://a.b/x", "p" * 200), (None, None, None), (3, "http://a.b/y", "q" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("captured", F.lit("mine"))
    got = warc.histories(spark, df).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0)] or sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0)]
    assert sorted(r.history_place for r in got) == list(range(6))
    late = warc.record(2 * 10**9, "http://a.b", b"x", "d", None)
    assert b"WARC-Date: 2087-05-18T03:33:20Z" in next(iter(warc.members(late)))[1]


def test_members_of_any_chunk():
    parts = [warc.record(i, f"http://h/{i}", bytes([i % 251]) * (i * 37 % 5000), "d", None) for i in range(40)]
    data = b"".join(parts)
    for chunk in (7, 1000, 1 << 16):
        found = list(warc.members(data, chunk))
        assert [p for p, _ in found] == [sum(map(len, parts[:i])) for i in range(40)]
    with pytest.raises(ValueError):
        list(warc.members(data[:-5]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9)), max_size=8), max_size=7))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_language(spark):
    rng, alphabets = random.Random(0), {"aa": "abcde ", "bb": "dghij ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(200)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)] + [(900, None, "aa"), (901, "12 !", "aa"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    got = by_id(language_id.identify(spark, df))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == k for i, _, k in rows[:180]) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(spark, df.limit(0)).count() == 0
    for k in (2, 3, 4, 9):
        words = language_id.codewords(k)
        assert len({tuple(w) for w in words}) == k


def test_language_held_out_accuracy_and_decoding(spark):
    """Every document of sf0.01: over 0.98 of those that training never saw are right; and the decoder against its definition."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = language_id.identify(spark, df).collect()
    held = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    again = {r.doc_id: r.score for r in language_id.identify(spark, df.repartition(7)).collect()}
    assert again == {r.doc_id: r.score for r in got}
    rng = np.random.default_rng(0)
    words = language_id.codewords(7)
    model = language_id.Model([f"l{i}" for i in range(7)], words, np.zeros((2, words.shape[1])), np.zeros(words.shape[1]), rng.random(words.shape[1]))
    margins = rng.normal(size=(50, words.shape[1]))
    best, score, close = model.decode(margins)
    for m, b, s_, c in zip(margins, best, score, close, strict=True):
        loss = [sum(w * np.log1p(np.exp(-x * bit)) for w, x, bit in zip(model.weight, m, word, strict=True)) for word in words]
        order = sorted(range(7), key=loss.__getitem__)
        assert b == order[0] and s_ == pytest.approx(np.exp(-4 * loss[b]) / sum(np.exp(-4 * x) for x in loss), rel=1e-4)
        assert c == (loss[order[1]] - loss[order[0]] < language_id.AMBIGUOUS) or abs(loss[order[1]] - loss[order[0]] - language_id.AMBIGUOUS) < 1e-5


def test_language_of_copies_and_many_languages(spark):
    """A language of one text copied often is learnt; more languages than the sample has room for don't stop it."""
    alphabet, rng = "abcdefghijklmnopqrstuvwxyz", random.Random(1)
    rows = [(3 * i, "qq ww " * 20, "copy") for i in range(300)] + [(3 * i + 1000, "".join(rng.choice("abcd ") for _ in range(100)), "abc") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(spark, df).collect()
    assert sum(r.lang_pred == ("copy" if r.doc_id < 900 else "abc") for r in got) == 360
    many = spark.createDataFrame([(i, alphabet[k % 26] * 5 + " " + alphabet[k // 26] * 5, f"l{k}") for k in range(60) for i in (k, k + 100)], "doc_id long, text string, lang string")
    model = language_id.train(spark, many, 40)
    assert 2 <= len(model.languages) <= 60


def test_licenses(spark, docs):
    got = by_id(licenses.scan_table(docs))
    assert (got[12].n_base, got[12].first_word, got[12].last_word, got[12].base_labels) == (4, 0, 8, "cc-by,gpl,reserved")
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == ""
    assert licenses.evaluate("(MIT OR GPL-3.0) AND Apache-2.0 WITH x") == ({"mit", "gpl-3.0", "apache-2.0"}, 1.0)
    assert licenses.evaluate("mit or gpl and agpl")[1] == 1.0 and licenses.evaluate("(mit or gpl) and agpl")[1] == 0.3
    assert all(licenses.postfix(bad) is None for bad in ("", "mit or", "(mit", "mit)", "mit gpl", "or mit", "()"))
    assert licenses.scan(b"x SPDX-License-Identifier: MIT OR GPL-2.0 */\nrest")[5] == "gpl-2.0,mit"


PIECES = ["cc by", "CC-BY", "general public license", "General\nPublic License", "all rights reserved", "lesser general public license", "mit license", "MIT", "é", "cc", "by", "public", "domain", "x", "cc0", ",", "License", "the"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_license_scan_equals_plain_search(parts):
    text = " ".join(parts)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in {**licenses.NOTICES, **licenses.BASE}.items() for label in [p]}
    base = sorted(i for p in licenses.BASE for i in at[p])
    labels = sorted({{**licenses.NOTICES, **licenses.BASE}[p] for p, places in at.items() if places})
    got = licenses.scan(text.encode())
    assert got[:4] == (len(words), len(base), min(base, default=None), max(base, default=None))
    assert got[4] == ",".join(sorted({licenses.BASE[p] for p in licenses.BASE if at[p]})) and got[5] == ",".join(labels)
    assert got[6] == min((licenses.openness(x) for x in labels), default=0.0)


def test_licenses_of_long_expressions():
    names = [f"lic-{i}" for i in range(500)]
    for line in (" and ".join([*names, "agpl-3.0"]), "(" + " or ".join(names) + ") and agpl-3.0", " or (".join([*names, "agpl-3.0"]) + ")" * 500):
        assert licenses.leading_expression(f"{line} */ and more") == " ".join(re.findall(r"[^\s()]+|[()]", line))
        got = licenses.scan(f"SPDX-License-Identifier: {line} */\nmit".encode())
        assert got[5] == ",".join(sorted([*names, "agpl-3.0"])) and got[6] == (0.5 if " or (" in line else 0.3)
    assert licenses.leading_expression("(" * 500 + "mit") == "("


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["mit", "GPL-2.0+", "and", "or", "with", "(", ")", "*/", "x,y", "İ"]), max_size=12))
def test_leading_expression_is_the_longest_start(tokens):
    starts = [part for n in range(len(tokens), 0, -1) if licenses.postfix(part := " ".join(tokens[:n])) is not None]
    assert licenses.leading_expression("  ".join(tokens)) == (starts[0] if starts else tokens[0] if tokens else "")


def test_media(spark, docs):
    got = by_id(media.described(docs))
    for i, t in TEXTS.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i].media_bytes == len(payload) + 44
    assert got[5].feature == got[6].feature != got[7].feature and got[1].feature.startswith("0:")
    pairs = media.read_media(media.encode_media(docs.filter("doc_id = 5"))).collect()[0]
    assert len(pairs.time) == len(pairs.code) > 0 and list(pairs.time) == sorted(pairs.time)


def test_media_fingerprint_by_its_definition(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(32, 127)) for _ in range(n)) for n in (1, 63, 64, 65, 700, 3000)]
    for text in texts:
        payload = media.padded(text.encode())
        x = [b - 128 for b in payload] + [0] * (media.FRAME - media.BLOCK)
        n = len(payload) // media.BLOCK
        strong, bins = [], []
        for f in range(n):
            frame = np.array(x[f * media.BLOCK : f * media.BLOCK + media.FRAME], dtype=float)
            frame = (frame - frame.mean()) * np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)])
            power = [abs(sum(v * np.exp(-2j * np.pi * k * i / media.FRAME) for i, v in enumerate(frame))) for k in range(1, media.FRAME // 2 + 1)]
            bins.append(int(np.argmax(power)))
            strong.append(max(power))
        at, found = media.peaks(payload)
        want = [f for f in range(n) if strong[f] > 0.01 and all(strong[f] >= strong[g] - 0.02 for g in (f - 1, f + 1) if 0 <= g < n)]
        assert set(at.tolist()) <= set(want) and len(at) >= len(want) - 1 and all(bins[f] == b for f, b in zip(at.tolist(), found.tolist(), strict=True))
        time, code = media.pair_codes(at, found)
        pairs = sorted((int(at[i]), int(found[i]) << 16 | int(found[j]) << 8 | int(at[j] - at[i])) for i in range(len(at)) for j in (i + 1, i + 2) if j < len(at) and at[j] - at[i] <= media.REACH)
        assert list(zip(time.tolist(), code.tolist(), strict=True)) == pairs
    long = "ab" * 150_000
    row = media.described(spark.createDataFrame([(1, long), (None, long), (2, None)], "doc_id long, text string").withColumn("code", F.lit(1))).collect()
    assert [r.feature for r in row][0] == row[1].feature and row[1].doc_id is None and row[0].payload_bytes == 300_032 and list(row[0].time) == sorted(row[0].time)
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"1234").replace(b"\x01\x00\x01\x00", b"\x01\x00\x02\x00"))


def test_scratch_goes(spark):
    import os

    with Scratch(spark) as scratch:
        a, b = scratch.cut(spark.range(3).toDF("a")), scratch.cut(spark.range(5).toDF("b"), keep=True)
        assert a.count() == 3
        before = len(os.listdir(scratch_dir(spark)))
    assert len(os.listdir(scratch_dir(spark))) == before - 1 and b.count() == 5
    clear(spark)
    assert not os.path.exists(scratch_dir(spark))


def test_words_pattern():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x1cc d") == [w.decode() for w in "a b\x1cc d".encode().split()]


@pytest.mark.parametrize("finish", [0, 5, 20_000])
def test_components_of_any_size_of_the_last_task(spark, monkeypatch, finish):
    monkeypatch.setattr(near_dedup, "FINISH", finish)
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(3, 2), (2, 1), (7, 7), (40, 30)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.id: r.comp for r in near_dedup.components(scratch, edges).collect()}
        assert got == dict.fromkeys([*range(10, 31), 40], 10) | dict.fromkeys([1, 2, 3], 1)
        assert near_dedup.components(scratch, edges.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.sets(st.integers(0, 9), min_size=1)), min_size=1, max_size=9))
def test_blocks_join_what_pairs_would(rows):
    """links_of against all pairs: the same components; an asking row also answers, as in by_blocks."""
    sets = [(i, comp, rest, np.array(sorted(s), dtype=np.uint64)) for i, (comp, rest, s) in enumerate(rows)]
    got = near_dedup.links_of([(i, comp, s) for i, comp, rest, s in sets if rest], sets)

    def merged(edges):
        of = {i: comp for i, comp, _, _ in sets}
        for a, b in edges:
            of = {i: of[b] if c == of[a] else c for i, c in of.items()}
        return sorted(sorted(i for i in of if of[i] == c) for c in set(of.values()))

    near = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    want = [(i, j) for i, _, rest, s in sets for j, _, _, t in sets if rest and i != j and near(s.tolist(), t.tolist())]
    assert set(got) <= set(want) and merged(got) == merged(want)


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_near_dedup_equals_all_pairs_around_the_threshold(spark, monkeypatch, block):
    """Copies of one text with few to many words changed, so that about half of all pairs are links, in one block or many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, base, rows = random.Random(11), [f"b{i}" for i in range(150)], []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(16)):
            words[k] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    got = by_id(near_dedup.groups(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == root and len(set(root.values())) > 5


def test_near_dedup_loses_no_row_of_null_or_repeated_id(spark):
    long = " ".join(f"v{i}" for i in range(300_000))  # 2 MB
    rows = [(None, "a b c d"), (None, "x y z"), (None, None), (None, None), (7, "q r s"), (7, "t u v"), (7, "q r s"), (9, "Q r s"), (3, long), (4, long + " end"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("mine"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.groups(spark, df).collect())
    assert got == sorted([(0, 0, True), (0, 0, True), (0, 0, True), (0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False), (3, 3, True), (4, 3, False)])
    kept = near_dedup.keep_one(spark, df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted([(0, 7), (0, 5), (0, 0), (0, 0), (7, 5), (7, 5), (3, len(long))])


def test_cutting_calls_python_once_a_text(spark, docs):
    """One Python step in the plan: a second one would cut each text again, in workers of its own."""
    plan = substring.without_repeats(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1


def test_bpe_gives_up_its_tokenizer_when_idle(monkeypatch):
    """A worker that has no task keeps neither vocabulary nor pieces; one whose next task comes soon keeps both."""
    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = f.read()
    batch = pa.table({"doc_id": [1, 2], "text": ["some words", None]}).to_batches()[0]
    encode = lambda: [r for b in bpe._encode(iter([batch]), spec) for r in b.to_pylist()]
    monkeypatch.setattr(bpe, "IDLE_S", 60.0)
    first = encode()
    kept = bpe._loaded(spec)
    monkeypatch.setattr(bpe, "IDLE_S", 0.2)
    assert encode() == first and bpe._loaded(spec) is kept and kept.known
    bpe._timer.join(10)
    assert bpe._loaded.cache_info().currsize == 0 and encode() == first
