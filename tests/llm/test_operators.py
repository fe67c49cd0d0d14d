"""The corpus operators against plain Python, on labelled rows held out, and on awkward tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markwise.llm import (
    decontaminate, importance, language_id, licenses, lm_scoring, minhash_dedup, order_minhash, packing, suffix_dedup,
    toxicity,
)
from markwise.llm.queries import QUERIES, _tokenizer
from tests.llm import brute
from tests.oracle import TESTDATA

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(table):
    return [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten " * 6
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, same), (5, same), (None, same), (None, None), (6, "one"), (7, "a a a a a a a a"), (8, "ß — 漢字 é")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], ROW)
    for name in ("id", "a", "b", "word", "window", "node", "class", "place", "target", "at", "_key", "found", "item_id"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


def test_near_duplicates(spark, docs):
    got = {i: (n, c) for i, n, c in of(QUERIES["op1_minhash_dedup"].build(spark, SF), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(docs)


def test_near_duplicate_chains(spark):
    """Copies that drift step by step are one class, though the ends are unlike; small leaves force branching."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(30):
        words = [*words[:10 * i], *(f"v{i}-{j}" for j in range(6)), *words[10 * i + 6 :]]
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    leaf, minhash_dedup.LEAF = minhash_dedup.LEAF, 2
    try:
        got = {i: (n, c) for i, n, c in of(minhash_dedup.near_duplicates(frame), "doc_id", "n_shingles", "component_id")}
    finally:
        minhash_dedup.LEAF = leaf
    assert got == brute.near_duplicates(texts)
    assert len({c for _, c in got.values()}) == 1


def test_links_of_small_sets(spark):
    """Pairs of 3 to 20 shingles at exactly 0.75: none is lost."""
    texts = []
    for k in range(400):
        words = [f"w{k}-{j}" for j in range(24)]
        n = k % 5 + 1
        pair = (words[: 4 * n + 4], words[: 3 * n + 4]) if k < 350 else (words[:11], words[1:12])
        texts += [(2 * k + i, " ".join(p)) for i, p in enumerate(pair)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {i: (n, c) for i, n, c in of(minhash_dedup.near_duplicates(frame), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(texts)
    assert all(c == i - i % 2 for i, (_, c) in got.items())


def test_license_places(spark, docs):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = {r[0]: r[1:] for r in of(QUERIES["op2_license_scan"].build(spark, SF), *names)}
    assert got == {i: brute.base_license_places(t) for i, t in docs}


def test_license_templates(spark):
    mit, keys = licenses.TEMPLATES["mit"]
    texts = [(1, f"x y. {mit} z"), (2, mit.replace("hereby granted", "never given")), (3, mit.replace("merge", "join")), (4, "the of and")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {i: (labels, score) for i, labels, score in of(licenses.scan(frame), "doc_id", "labels", "score")}
    assert got[1] == ("mit", 1.0)
    assert got[2] == ("", 0.0) and got[4] == ("", 0.0)
    assert got[3][0] == "mit" and 0.8 < got[3][1] < 1


def check_packing(rows, ids):
    parts, sequences = {}, {}
    for doc, start, n, crc, total, sequence, offset in rows:
        assert brute.crc(ids[doc][start : start + n]) == crc and total == len(ids[doc])
        parts.setdefault(doc, []).append((start, n))
        sequences.setdefault(sequence, []).append((offset, n))
    for found, size in [*((parts[d], len(ids[d])) for d in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(found):
            assert start == at and n > 0
            at += n
        assert at == size or size is None and at <= 4096
    return len(sequences)


def test_packing(spark, docs):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ids = dict(zip([i for i, _ in docs], brute.token_ids([t for _, t in docs], _tokenizer()), strict=True))
    n = check_packing(of(QUERIES["op3_packing"].build(spark, SF), *names), ids)
    assert n <= sum(map(len, ids.values())) / 4096 + 2


def test_packing_limits(table):
    limits = packing.Limits(tokens=256, segments=3, loss=200)
    rows = packing.pack(table("documents"), _tokenizer(), limits)
    worst = rows.groupBy("sequence_id").agg(F.sum("length"), F.count(F.lit(1)), F.sum("loss_tokens")).agg(*[F.max(c) for c in ("sum(length)", "count(1)", "sum(loss_tokens)")]).first()
    assert worst[0] <= 256 and worst[1] <= 3 and worst[2] <= 200
    assert rows.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).filter("NOT whole").isEmpty()


def test_prompts_bear_no_loss(spark):
    frame = spark.createDataFrame([(1, "a b c", "d e")], "doc_id bigint, text string, prompt string")
    row = packing.pack(frame, _tokenizer(), prompt="prompt").first()
    assert (row.length, row.loss_tokens) == (6, 4)


def test_repeated_strings(spark, docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = sorted(of(QUERIES["op4_suffix_dedup"].build(spark, SF), *names))
    assert got == sorted(brute.without_repeats(docs))


def test_index_levels(spark, docs):
    """Many small batches, merged level by level, find what one batch finds."""
    frame = spark.createDataFrame(docs[:60], "doc_id bigint, text string")
    rows = suffix_dedup.remove_repeats(frame, batch_bytes=30_000)
    got = sorted(of(rows.select("doc_id", "cut.n_removed", "cut.n_spans"), "doc_id", "n_removed", "n_spans"))
    assert got == sorted((i, n, s) for i, _, n, s, _ in brute.without_repeats(docs[:60]))


def test_contamination(spark, table, docs):
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r[0]: r[1:] for r in of(QUERIES["op7_decontaminate"].build(spark, SF), *names)}
    assert got == brute.contamination(docs, items)


def test_contamination_by_shuffle(spark, table, docs, odd, monkeypatch):
    """A prefix table too large to send: words move without their documents, results are the same."""
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    one_word = spark.createDataFrame([(1, "a"), (2, "one two three"), (3, "a a"), (None, "x")], "item_id bigint, text string")
    sent = sorted(of(decontaminate.decontaminate(odd, one_word), *names), key=str)
    monkeypatch.setattr(decontaminate, "MOST_SENT", 0)
    monkeypatch.setattr(decontaminate, "PER_ROW", 2)
    assert sorted(of(decontaminate.decontaminate(odd, one_word), *names), key=str) == sent
    assert {r[0] for r in sent if r[5]} == {None, 5, 7}
    met, fetch = [], decontaminate._with_documents
    monkeypatch.setattr(decontaminate, "_with_documents", lambda rows, named: met.append(rows.columns) or fetch(rows, named))
    got = {r[0]: r[1:] for r in of(decontaminate.decontaminate(table("documents"), table("benchmark")), *names)}
    assert got == brute.contamination(docs, items)
    assert met and "parts" not in met[0]


def test_short_items_and_case(spark):
    docs = [(1, "x Big BANG y big bang"), (2, "ÉCOLE big"), (3, None), (4, "école"), (None, "big bang")]
    items = [(1, "big bang"), (2, "école"), (3, "..."), (None, "x"), (4, None)]
    got = {r[0]: r[1:] for r in of(
        decontaminate.decontaminate(
            spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        ), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    assert got == brute.contamination(docs, items)


def test_capital_sigma(spark):
    """The case of a word does not depend on what stands around it."""
    docs = [(k, f"ΠΕΡΙ ΤΗΣ{by}ΑΛΛ one Two") for k, by in enumerate(". : ' - , _ .\n".split(" "))]
    docs += [(10, "ΤΗΣ ΑΛΛ"), (11, "της αλλ"), (12, "τησ αλλ"), (13, "xΣ.Y"), (14, "Xσ y"), (15, "Xς Y"), (16, "XΣ Y")]
    items = [(1, "ΤΗΣ:ΑΛΛ"), (2, "ΤΗΣ ΑΛΛ one"), (3, "ΠΕΡΙ ΤΗΣ'ΑΛΛ ONE tWO"), (4, "Xσ Y"), (5, "XΣ'y")]
    got = {r[0]: r[1:] for r in of(
        decontaminate.decontaminate(
            spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        ), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    assert got == brute.contamination(docs, items)
    assert got[0][4] and got[1][4]


def test_fingerprints(spark, docs):
    rows = QUERIES["op9_order_minhash"].build(spark, SF).collect()
    want, prints, of_text = brute.edited_texts(docs), {r.doc_id: r.fingerprint for r in rows}, {}
    like = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / order_minhash.SKETCHES
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint), abs=1e-6)
        assert r.near_next == pytest.approx(like(r.fingerprint, prints[want[r.doc_id][3]]), abs=1e-6)
    for i, text in docs:
        of_text.setdefault(text, set()).add(prints[i])
    assert all(len(p) == 1 for p in of_text.values())


def test_occurrence_numbers(spark):
    """Copies of a k-mer are numbered from the left; order matters to the likeness."""
    frame = spark.createDataFrame([(1, "a a a a a a b"), (2, "b a a a a a a")], "doc_id bigint, text string")
    found = frame.select(F.size(F.array_distinct(order_minhash.numbered(order_minhash.kmers(F.split("text", " "))))).alias("n"))
    assert [r.n for r in found.collect()] == [5, 5]


def test_toxicity_held_out(spark, table):
    docs, labels = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = docs.select("doc_id", toxicity.grade(model, F.col("text")).alias("g")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    counts = {(r.toxic, r.found): r["count"] for r in rows.groupBy("toxic", F.col("g.toxic").alias("found")).count().collect()}
    assert counts[1, True] / (counts[1, True] + counts.get((1, False), 0)) > 0.85
    assert counts.get((0, True), 0) / counts[0, False] < 0.01
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()


def test_languages_held_out(spark, table):
    rows = QUERIES["op8_language_id"].build(spark, f"{TESTDATA}/sf0.01")
    truth = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_quality_and_scores_separate(spark):
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    kept = QUERIES["op6_importance"].build(spark, f"{TESTDATA}/sf0.01").join(labels, "doc_id")
    share = {r.quality: r.s for r in kept.groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[1] > 0.8 and share[0] < 0.3
    scored = QUERIES["op10_lm_scoring"].build(spark, f"{TESTDATA}/sf0.01").join(labels, "doc_id")
    loss = {r.quality: r.s for r in scored.groupBy("quality").agg(F.avg("loss_difference").alias("s")).collect()}
    assert loss[1] < loss[0]


@pytest.mark.parametrize("block_bytes", [20_000, lm_scoring.BLOCK_BYTES])
def test_scores_of_all_words(spark, docs, block_bytes):
    """Every word and pair of the corpus has its own counts, in one block and in many."""
    rows = [*docs, (10**6, None), (10**6 + 1, " "), (10**6 + 2, "Rare rare once")]
    target = {i for i, _ in docs[::3]} | {10**6 + 2}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in target), 0) for i, _ in rows], LABELS)
    names = ("doc_id", "n_words", "target_loss", "background_loss", "loss_difference")
    got = {r[0]: r[1:] for r in of(lm_scoring.score_documents(frame, labels, block_bytes=block_bytes), *names)}
    want = brute.bigram_scores(rows, target)
    assert len({w for _, t in docs for w in t.split()}) > 2047 and got.keys() == want.keys()
    for i, row in want.items():
        assert got[i] == pytest.approx(row, abs=2e-6), i


def test_kth_largest(spark):
    values = [5, -3, 5, 2**40, -(2**50), 0, 7]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [importance.kth_largest(frame, "v", k) for k in range(1, 8)] == sorted(values, reverse=True)


def operators(spark, frame):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (None, 1, 1), (99, None, None), (5, 0, 1)], LABELS)
    items = spark.createDataFrame([(1, "one two three"), (None, "x"), (2, None)], "item_id bigint, text string")
    return {
        "op1": minhash_dedup.near_duplicates(frame), "op2": licenses.scan(frame), "op3": packing.pack(frame, _tokenizer()),
        "op4": suffix_dedup.remove_repeats(frame).select("doc_id", "cut.*"),
        "op5": toxicity.grade_documents(frame, labels), "op6": importance.resample(frame, labels),
        "op7": decontaminate.decontaminate(frame, items), "op8": language_id.identify_languages(frame),
        "op9": order_minhash.fingerprint_documents(frame), "op10": lm_scoring.score_documents(frame, labels),
    }


def test_awkward_tables(spark, odd):
    n = odd.count()
    for name, result in operators(spark, odd).items():
        rows = result.collect()
        assert len(rows) >= n if name == "op3" else len(rows) == n, name
        if name == "op1":
            assert {r.component_id for r in rows if r.doc_id == 5} == {5}
            assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
            assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
        if name == "op8":
            assert {r.lang_pred for r in rows} == {"und"}


def test_empty_tables(spark, odd):
    for name, result in operators(spark, odd.limit(0)).items():
        assert result.count() == 0, name


def test_clashing_columns(spark):
    """Columns named like the operators' own come out as they went in."""
    own = ("_id", "_key", "_spans", "_found", "spans", "row", "id", "found", "parts", "name")
    same = "one two three four five six seven eight nine ten " * 6
    frame = spark.createDataFrame([(1, same, "en", "s", 1), (2, same + "x", "en", "s", 2), (3, None, None, None, None)], ROW)
    for name in (*own, "cut"):
        frame = frame.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id")))
    cut = suffix_dedup.remove_repeats(frame)
    assert sorted(cut.columns) == sorted(frame.columns)
    assert {(r.doc_id, r.cut.n_removed > 0) for r in cut.collect()} == {(1, True), (2, True), (3, False)}
    stages = dict(corpus_pipeline.STAGES)
    for result in (cut, stages["toxicity"](spark, frame, SF), stages["decontamination"](spark, frame, SF)):
        rows = result.collect()
        assert len(rows) == 3 and all(r[name] == f"{name}-{r.doc_id}" for r in rows for name in own)


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], ROW)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty()


def test_pipeline_by_hand(spark, table, docs):
    """Each stage against plain Python on what it was given; packing covers what is left."""
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    rows, model = table("documents"), toxicity.fit(table("documents"), table("labels"))
    toxic = {r.doc_id for r in rows.select("doc_id", toxicity.grade(model, F.col("text"))["toxic"].alias("t")).filter("t").collect()}
    held = {"documents": dict(docs)}
    frame = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = minhash_dedup.settle(stage(spark, frame, SF))
        held[name] = {r.doc_id: r.text for r in frame.collect()}
        assert frame.count() == len(held[name])
    assert 0 < len(toxic) < len(docs)
    assert held["toxicity"] == {i: t for i, t in docs if i not in toxic}
    classes = brute.near_duplicates(list(held["toxicity"].items()))
    assert held["near_duplicates"] == {i: t for i, t in held["toxicity"].items() if classes[i][1] == i}
    texts = list(held["near_duplicates"].items())
    assert held["suffix_dedup"] == brute.cut_texts(texts)
    dirty = brute.contamination(list(held["suffix_dedup"].items()), items)
    assert held["decontamination"] == {i: t for i, t in held["suffix_dedup"].items() if not dirty[i][4]}
    left = list(held["decontamination"].items())
    ids = dict(zip([i for i, _ in left], brute.token_ids([t for _, t in left], _tokenizer()), strict=True))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_packing(of(corpus_pipeline.STAGES[-1][1](spark, frame, SF), *names), ids)


def test_pipeline(spark, odd):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id for r in docs.collect()} >= {None, 1, 2, 3, 4, 5, 6, 7, 8}


def test_leaf_comparison(spark, docs, monkeypatch):
    """One leaf of all documents: every link is found, the spanning pairs join what all pairs join, blocks lose nothing."""
    unique = minhash_dedup.sketches(spark.createDataFrame(docs, "doc_id bigint, text string")).filter("n_shingles > 0")
    unique = unique.dropDuplicates(["set_a", "set_b"])
    classed = unique.withColumn("class", F.when(F.col("doc_id") % 5 == 0, F.lit(-1)).otherwise(F.col("doc_id")))
    leaf = classed.select(*minhash_dedup.MEMBER, F.lit(1).alias("node"), F.lit(-1).alias("main"), F.lit(0).alias("block")).toArrow()
    leaf = minhash_dedup._arrays(leaf)
    found = minhash_dedup._compare(leaf, 0, len(leaf.doc), spanning=False)
    pairs = lambda rows: {(r[0], r[1]) for r in rows}
    every = pairs(found)

    def joined(links):
        top = {}
        of = lambda x: x if top.setdefault(x, x) == x else of(top[x])
        class_of = {i: -1 if i % 5 == 0 else i for ends in links for i in ends}
        for a, b in links:
            top[of(class_of[a])] = of(class_of[b])
        return {frozenset(x for x in top if of(x) == r) for r in map(of, list(top))}

    spanning = pairs(minhash_dedup._compare(leaf, 0, len(leaf.doc), spanning=True))
    assert spanning <= every and joined(spanning) == joined(every)
    members = classed.select(*minhash_dedup.MEMBER, F.lit(1).alias("node"), F.lit(-1).alias("main"), F.lit(1000).alias("total"))
    for block in (40, 4096):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        assert pairs(minhash_dedup._leaf_pairs(members, spanning=False).collect()) == every
    want = brute.near_duplicates(docs)
    sure = [(a, b) for a, b, s in found if s]
    assert all(want[a][1] == want[b][1] for a, b in sure)


def test_near_copies_below_the_limit(spark, monkeypatch):
    """A group whose pairs are nearly all alike and no links: what is tested on texts grows with its size, not with its pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(400), 8):
            words[at] = f"v{i}-{at}"
        texts.append((i, " ".join(words)))
        if i % 10 == 0:
            texts.append((1000 + i, " ".join([*words, "end"])))
    tested, confirmed = [], minhash_dedup.confirmed

    def counted(docs, pairs):
        tested.append(pairs.count())
        return confirmed(docs, pairs)

    monkeypatch.setattr(minhash_dedup, "confirmed", counted)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {i: (n, c) for i, n, c in of(minhash_dedup.near_duplicates(frame), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(texts)
    assert len({c for _, c in got.values()}) > 100
    assert sum(tested) <= 20 * len(texts)


def test_wide_groups_are_one_level(spark, monkeypatch):
    """Hundreds of copies that are no links make one level of few queries; levels let go of what the ones before left in the driver."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(700):
        words = list(base)
        for at in rng.sample(range(100), 4):
            words[at] = f"v{i}-{at}"
        texts.append((i, " ".join(words)))
        if i % 50 == 0:
            texts.append((1000 + i, " ".join([*words, "end"])))
    frame, wide, freed = spark.createDataFrame(texts, "doc_id bigint, text string"), [], []
    branches, let_go = minhash_dedup.branches, minhash_dedup.let_go
    monkeypatch.setattr(minhash_dedup, "branches", lambda rows: wide.append(rows) or branches(rows))
    monkeypatch.setattr(minhash_dedup, "let_go", lambda session: freed.append(session) or let_go(session))
    got = {i: (n, c) for i, n, c in of(minhash_dedup.near_duplicates(frame), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_duplicates(texts)
    assert len({c for _, c in got.values()}) > 600
    assert not wide and freed


def test_driver_lets_go(spark, odd, monkeypatch):
    """What Python no longer holds is gone from the driver, and the pipeline's stage asks for that first, before the stars and on each level."""
    jvm, freed, let_go = spark.sparkContext._jvm, [], minhash_dedup.let_go
    monkeypatch.setattr(minhash_dedup, "let_go", lambda session: freed.append(session) or let_go(session))
    left = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    assert left.get() is not None
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_duplicate_stage(spark, rows, SF).count() == 10
    assert len(freed) >= 3 and left.get() is None


def test_links_of_one_row(spark, docs):
    """The links of a row by the sets of the others and by the holders of its shingles are those of plain sets."""
    unique = minhash_dedup.sketches(spark.createDataFrame(docs, "doc_id bigint, text string")).filter("n_shingles > 0").drop("small")
    sets = {i: s for c in minhash_dedup.chunks(minhash_dedup.pa.array([t for _, t in docs])) for i, s in zip(
        [i for i, _ in docs[c.first : c.last]], minhash_dedup.shingle_sets(c), strict=True)}
    small = spark.createDataFrame([(i, [int(x) for x in s.view("int64")]) for i, s in sets.items()], "doc_id bigint, small array<bigint>")
    rows = unique.join(small, "doc_id").withColumn("class", F.col("doc_id"))
    rows = rows.select(*minhash_dedup.MEMBER, F.lit(1).alias("node"), F.lit(-1).alias("main"), F.lit(0).alias("block")).toArrow()
    members = minhash_dedup._arrays(rows)
    block, plain = minhash_dedup._Block(members, 0, len(members.doc)), [set(sets[i].tolist()) for i in members.doc.tolist()]
    for i in range(len(plain)):
        n = [len(plain[i] & x) * 100 >= len(plain[i] | x) * 75 for x in plain]
        for step in (1, 40):
            near = minhash_dedup.np.arange(i % step, len(plain), step)
            assert block.similar(i, near).tolist() == [j for j in near.tolist() if n[j]]


def test_leaf_blocks_with_full_sets(spark, docs):
    """One leaf of all documents, compared on full sets: blocks join what one block joins, and links only."""
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    unique = minhash_dedup.sketches(frame).filter("n_shingles > 0").dropDuplicates(["set_a", "set_b"])
    classed = unique.withColumn("class", F.when(F.col("doc_id") % 5 > 0, F.lit(-1)).otherwise(F.col("doc_id")))
    classed = classed.select(*minhash_dedup.MEMBER, F.lit(1).alias("node"), F.lit(-1).alias("main"), F.lit(1000).alias("total"))
    small = {r.doc_id: {r["class"]} for r in classed.select("doc_id", "class").collect()}
    every = minhash_dedup._leaf_pairs(classed, spanning=False).collect()
    true = brute.near_duplicates(docs)
    sets = spark.createDataFrame(
        [(i, [int(x) for x in s.view("int64")]) for c in minhash_dedup.chunks(minhash_dedup.pa.array([t for _, t in docs])) for i, s in
         zip([i for i, _ in docs[c.first : c.last]], minhash_dedup.shingle_sets(c), strict=True)],
        "doc_id bigint, small array<bigint>",
    )
    members = classed.drop("small").join(sets, "doc_id")

    def joined(links):
        top = {}
        root = lambda x: x if top.setdefault(x, x) == x else root(top[x])
        name = {i: next(iter(k)) for i, k in small.items()}
        for a, b in links:
            top[root(f"c{name[a]}")] = root(f"c{name[b]}")
        return {frozenset(x for x in top if root(x) == r) for r in map(root, list(top))}

    links = {(r.a, r.b) for r in every if true[r.a][1] == true[r.b][1]}
    assert links
    for blocks in (1, 7):
        found = minhash_dedup._in_blocks(members, F.lit(blocks).cast("bigint"), minhash_dedup._compare_sets, "a bigint, b bigint").collect()
        assert {(r.a, r.b) for r in found} <= links
        assert joined((r.a, r.b) for r in found) == joined(links)


@pytest.mark.parametrize("size", [1 << 18, 1])
def test_texts_by_id_map(spark, odd, monkeypatch, size):
    """The map of ids lets more texts pass or fewer; the rows are the same, and the map comes before the join."""
    monkeypatch.setattr(minhash_dedup, "MAP_WORDS", size)
    rows = odd.select("doc_id", "text")
    got = minhash_dedup._texts(rows, spark.createDataFrame([(1,), (5,), (6,), (99,)], "doc_id bigint"))
    assert sorted(i for i, _ in of(got, "doc_id", "text")) == [1, 5, 6]
    assert dict(of(got, "doc_id", "text"))[6] == "one"
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    needed = spark.range(0, 100_000, 1000).select(F.col("id").alias("doc_id"))
    plan = minhash_dedup._texts(many, needed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (doc_id") < plan.index("getbit")
    assert minhash_dedup._texts(many, needed).count() == 100
