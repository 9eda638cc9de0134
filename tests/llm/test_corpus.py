"""Classifiers by held-out accuracy, fingerprints and components by brute force, archives by round trip, the pipeline stage by stage."""

import gzip
import random
import subprocess
import sys
import time
import zlib
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import common, langid, queries, simhash, toxicity, warc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_levenshtein():
    r = random.Random(0)
    terms = tuple({"".join(r.choice("abc") for _ in range(r.randrange(2, 10))) for _ in range(40)})
    a = toxicity.TermAutomaton(terms)
    for _ in range(400):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(1, 11)))
        want = sorted((t, d) for t in terms if (d := distance(t, word)) <= toxicity.edits_allowed(t))
        assert a.lookup(word) == want


def test_quotation_counts_less_than_abuse():
    m = toxicity.ToxicityModel({"idiot": 1.0}, frozenset(), (1.0,) * 5)
    weight = lambda text: sum(h[3] for h in m.hits(text))
    assert weight("you are an idiot") > weight("an idiot") > weight('he said "idiot" to me') > 0
    assert weight("you are an idiiot") > 0 and weight("idea") == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id").where(common.held_out("doc_id")), model).select("toxic", "toxicity").collect()
    pos, neg = ([r["toxicity"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc >= 0.95


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3.0), (1, "", 4.0), (None, "x " * 50000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 3 and all(0 <= r["toxicity"] < 0.5 for r in rows) and {r["score"] for r in rows} == {3.0, 4.0, 5.0}
    with pytest.raises(ValueError):
        toxicity.score(df, model, score_col="score")
    assert toxicity.score(df.limit(0), model).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).where(common.held_out("doc_id"))
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count()


def test_filters_have_no_false_negatives():
    r = np.random.default_rng(0)
    grams = {k: r.integers(0, 2**63, 5000).astype(np.uint64) for k in "abc"}
    f = langid.LanguageFilter.build(tuple("abc"), grams)
    for i, k in enumerate("abc"):
        assert ((f.members(grams[k]) >> np.uint64(i)) & np.uint64(1)).all()
    other = f.members(r.integers(0, 2**63, 50000).astype(np.uint64))
    for i in range(3):
        assert ((other >> np.uint64(i)) & np.uint64(1)).mean() == pytest.approx(f.share[i] ** f.hashes, abs=0.01)


def test_language_odd_rows(spark):
    rows = [(k, "the cat sat on the mat and then it ran", "en") for k in range(10)] + [(k, "der hund und die katze sind nicht hier", "de") for k in range(10, 20)] + [(20, None, None), (21, "123 !?", "en"), (22, "", None), (None, "die katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[0]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all((got[k]["lang_pred"], got[k]["lang_score"]) == ("und", 0.0) for k in (20, 21, 22))
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_many_languages_and_marks(spark):
    r = random.Random(2)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 40)]
    word = lambda k: "".join(r.choice(alphabet[40 * k : 40 * k + 40]) for _ in range(4))
    rows = [(100 * k + j, " ".join(word(k) for _ in range(30)), f"l{k:02}") for k in range(70) for j in range(12)] + [(-1, "\u0301\u0300 \u0301", "l01")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 70 and model.slots.shape[1] == 2
    got = {x["doc_id"]: (x["lang_pred"], x["lang"]) for x in langid.identify(df, model).collect()}
    assert got.pop(-1)[0] == "und"
    assert np.mean([a == b for a, b in got.values()]) > 0.98


def test_one_text_of_a_repeated_id_teaches(spark):
    rows = [(1, f"you are an idiot {k}") for k in range(3000)] + [(k, f"a calm text number {k}") for k in range(2, 60)]
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.desc("text")), labels)
    assert a.weights == b.weights and a.coef == b.coef


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_fingerprints(spark):
    texts = ["", "a", "a b c", "A b C d e f", "x y z\x0bq w", "é É word", "\x1c a b c d e"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r[0]: r[1] & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {**{k: plain_fingerprint(t) for k, t in enumerate(texts)}, 99: 0}


def test_links_lose_nothing(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randrange(0, 40)):
            y = x
            for b in r.sample(range(64), r.randrange(1, 6)):
                y ^= 1 << b
            fps.add(y)
            x = y if r.random() < 0.3 else x
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    want = components(near, fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for rows, cell in ((10**9, 10**9), (10**9, 20), (16, 16384), (100, 7), (1, 3)):  # one order or many, whole groups or cells
        got = components([(r[0] & (2**64 - 1), r[1] & (2**64 - 1)) for r in simhash.links(df, group_rows=rows, cell_rows=cell).collect()], fps)
        assert got == want


def test_near_duplicates_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in docs.collect()}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(near, fps)
    rows = queries.op5_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == fps


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    got = dict(map(tuple, common.components(edges).collect()))
    assert got == {**{k: 0 for k in range(201)}, 600: 600, 601: 600}


PAGE = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    x = "y" * 1500
    rows = [(1, "u", x), (2, "u\r\nEvil: 1", x), (2, "u", x), (None, None, x), (5, "u", None), (6, "é", "é" * 600), (7, "z", "é" * 600), (8, "s", "short"), (9, "s", "short"), (10, "h", "a\r\n\r\nWARC/1.1\r\n")]
    archives = warc.archive(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}")
    got = warc.read_archives(archives, members_per_part=2).collect()
    of = sorted(((r["record_id"], r["type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in got), key=repr)
    ref = lambda k: f"<urn:page:{k}>"
    assert of == sorted([
        (ref(1), "revisit", ref(2), None), (ref(2), "response", None, x), (ref(2), "response", None, x), (ref("null"), "revisit", ref(2), None), (ref(5), "response", None, ""),
        (ref(6), "revisit", ref(7), None), (ref(7), "response", None, "é" * 600), (ref(8), "response", None, "short"), (ref(9), "response", None, "short"), (ref(10), "response", None, "a\r\n\r\nWARC/1.1\r\n"),
    ], key=repr)
    a = archives.first()["archive"]
    raw = open(a.removeprefix("file://"), "rb").read()
    index = [line.split("\t") for line in open(a.removeprefix("file://") + ".idx")]
    for offset, length, kind, *_ in index:  # each record can be reached on its own
        one = zlib.decompressobj(31)
        data = one.decompress(raw[int(offset) : int(offset) + int(length)])
        assert one.eof and not one.unused_data and f"WARC-Type: {kind}".encode() in data
    assert sum(int(x[1]) for x in index) == len(raw)


def test_normaliser_streams_any_members(tmp_path):
    record = lambda k: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {k}\r\n\r\n".encode() + b"z" * k + warc.END
    source = tmp_path / "in.gz"
    source.write_bytes(gzip.compress(record(3) + record(0)) + gzip.compress(record(3_000_000)))
    assert warc.normalise_file(str(source), str(tmp_path / "out.warc.gz"))[0] == 3
    assert gzip.decompress((tmp_path / "out.warc.gz").read_bytes()) == record(3) + record(0) + record(3_000_000)
    source.write_bytes(gzip.compress(record(3) + record(50))[:-30])
    with pytest.raises(Exception, match="early|cut off|Error"):
        warc.normalise_file(str(source), str(tmp_path / "bad.warc.gz"))


def test_empty_archives(spark):
    df = spark.createDataFrame([], PAGE)
    with pytest.raises(ValueError):
        warc.decided(df.withColumn("record_type", F.lit("x")))
    assert warc.read_archives(warc.archive(df)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "line_dedup", "simhash", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        before, after = docs.count(), out.count()
        assert 0 < after <= before and (name != "line_dedup" or after == before)
        if name == "simhash":
            at = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
            assert {r["doc_id"] for r in out.collect()} == set(components(similar_pairs(at), at).values())
        docs = out
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_on_odd_rows(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "the cat and the dog", "en", "s", 19), (2, "the cat and the dog", "en", "s", 19), (3, "le chat et le chien", "fr", "s", 19)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            docs = common.cut(stage(spark, docs, sf_dir))
        docs.count()


def test_unknown_languages_go_and_clean_documents_stay(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(4)
    letters = lambda chars, n: " ".join("".join(r.choice(chars) for _ in range(r.randrange(3, 10))) for _ in range(n))
    odd = [(-1 - k, letters(chars, n), None) for k, (chars, n) in enumerate((c, n) for c in ("αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцч", "abcdefghijklmnopqrstuvwxyz") for n in (5, 20, 100, 1000) for _ in range(10))]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    kept = {x["doc_id"] for x in corpus_pipeline.keep_known_languages(spark, rows, "").collect()}
    assert not {k for k, _, _ in odd} & kept
    clean = [x["doc_id"] for x in docs.where("size(split(text, ' ')) >= 20").select("doc_id").collect()]
    assert len(set(clean) & kept) >= 0.99 * len(clean)


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_pairs(at):
    both = lambda a, b: len(at[a] & at[b])
    return [(a, b) for a, b in combinations(at, 2) if 5 * (n := both(a, b)) >= 4 * (len(at[a]) + len(at[b]) - n)]


@pytest.mark.parametrize("turn", (0, 1))
def test_near_duplicates_keep_each_text_of_a_repeated_id(spark, sf_dir, turn):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b = "one two three four five six seven", "quite another text that shares nothing with it"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (None, b + " at all", "n"), (None, None, "e")]
    docs = spark.createDataFrame(rows[::-1] if turn else rows, "doc_id long, text string, extra string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(3, a, "x"), (5, b, "z"), (None, b + " at all", "n"), (None, None, "e")], key=repr)


def test_tree_prunes_and_loses_nothing():
    r = np.random.default_rng(3)
    x = np.unique(r.integers(0, 2**64, 9000, np.uint64))
    more = x[:1000] ^ (np.uint64(1) << r.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 1000).astype(np.uint64))
    x = np.unique(np.r_[x, more])
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    cell = simhash.Cell(simhash.at_rank(np.sort(rank).view(np.int64)))
    a, b, compared = simhash.link_cells(cell, cell, 4)
    near = [(int(x[k]), int(x[j])) for k in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= 4) + k + 1]
    nodes = set(sum(near, ()))
    assert components(list(zip(a.tolist(), b.tolist())), nodes) == components(near, nodes) and len(near) > 900
    assert 2 * compared < 0.75 * len(x) ** 2 * 2  # whole groups were dropped unseen


def test_stage_drops_copies_at_jaccard_08_and_more(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**5)}"
    rows, k = [(None, "", 1), (5000, None, 2), (5001, "a b c", 3), (5002, "A  b c", 4), (5003, "a b d", 5)], 0
    rows += [(9000, " ".join(str(x) for x in range(80)), 6), (None, " ".join(str(x) for x in range(79)), 7)]
    for n in (8, 40, 150, 400):
        for share in (0.002, 0.01, 0.02, 0.03, 0.05):
            for _ in range(6):  # copies of copies too
                words = [word() for _ in range(n)]
                for _ in range(3):
                    rows.append((k, " ".join(words), 0))
                    k += 1
                    words = [word() if r.random() < share else w for w in words]
    base = [word() for _ in range(60)]
    for _ in range(120):  # one large group, and a line that many have
        words = list(base)
        words[r.randrange(60)] = word()
        rows += [(k, " ".join(words), 0), (k + 1, " ".join(base[:9] + [word() for _ in range(30)]), 0)]
        k += 2
    at = {i: shingles(t) for i, (_, t, _) in enumerate(rows)}
    near = similar_pairs(at)
    assert sum((plain_fingerprint(rows[a][1] or "") ^ plain_fingerprint(rows[b][1] or "")).bit_count() > 4 for a, b in near) > 50  # pairs that four bits don't find
    groups = {}
    for i, root in components(near, at).items():
        groups.setdefault(root, []).append(rows[i][0])
    want = {min((x for x in ids if x is not None), default=None) for ids in groups.values()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


FORKED = """
import subprocess
import numpy as np
subprocess.Popen(["true"], preexec_fn=lambda: None).wait()  # as a session starts its JVM
from tidemark.llm import packing
r = np.random.default_rng(1)
a = r.normal(size=(150, 150))
assert np.abs(packing.inverted(a) @ a - np.eye(150)).max() < 1e-8
p = packing.plan({n: int(r.integers(1, 400)) for n in range(1, 1024)})
print(p.end)
"""


def test_packing_plans_after_a_fork():
    """numpy's own inverse stands still there."""
    done = subprocess.run([sys.executable, "-c", FORKED], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 0, done.stderr


def test_near_duplicates_leave_no_shuffle_files(spark):
    """Each step's files go with the step, not when the driver happens to collect its garbage."""
    from tidemark.llm import similar

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x.split("shuffle_")[1].split("_")[0] for x in found.split("\n") if "shuffle_" in x}  # by shuffle

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(name, None), files()
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"x{k}"] if k % 2 else [f"y{k}_{n}" for n in range(20)])) for k in range(40)], "doc_id long, text string")
    groups = similar.near_duplicates(docs)
    assert spark.conf.get(name, None) == set_before
    end = time.time() + 20
    while len(left := files() - before) > 3 and time.time() < end:  # files go a moment after their step
        time.sleep(0.2)
    assert len(left) <= 3  # a stage that adaptive execution no longer waited for may still have ended
    assert {r["component_id"] for r in groups.collect()} == {1, *range(0, 40, 2)}
    with pytest.raises(ValueError, match="mine"), common.shuffles_freed(spark):
        raise ValueError("mine")
    assert spark.conf.get(name, None) == set_before


def test_slices_are_bounded_and_lose_no_row():
    def batch(*texts):
        return pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})

    texts = [None, "", "a" * 5000, *("b" * n for n in range(200)), "c" * 3000]
    got = list(common.in_slices(iter([batch(*texts), batch(), batch("d")]), 1000))
    assert [t for b in got for t in b.column(0).to_pylist()] == [*texts, "d"]
    assert all(b.nbytes <= 1000 or b.num_rows == 1 for b in got) and sum(not b.num_rows for b in got) == 1


def test_classifiers_see_a_bounded_part_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: SimpleNamespace(value=x))  # else the class must be known to workers

    class Sees:
        """A model whose scores are the characters it is given at once."""

        languages = ("x",)

        def score(self, texts):
            return np.full(len(texts), float(sum(map(len, texts))))

        def measure(self, texts):
            return ["x"] * len(texts), self.score(texts), np.zeros(len(texts)), np.zeros(len(texts))

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    for out in (langid.identify(docs, Sees(), score_col="s"), toxicity.score(docs, Sees(), score_col="s")):
        n, ids, most = out.agg(F.count("text"), F.count_distinct("doc_id"), F.max("s")).first()
        assert (n, ids) == (3000, 3000) and most <= common.SLICE


def test_language_of_texts_over_several_blocks(monkeypatch):
    texts = ["", None, *(f"the {w} of them went over there " * n for n in (1, 40, 400) for w in ("house", "river", "winter"))]
    grams = [np.concatenate([h for c, d in langid._blocks([t]) for h, _ in langid._grams(c, d)]) for t in ("the house over there ", "river winter them went ")]
    model = langid.LanguageFilter.build(("a", "b"), dict(zip("ab", grams)))
    found = []
    for together in (langid.BLOCK, 1000, 1):
        monkeypatch.setattr(langid, "TOGETHER", together, raising=False)
        found.append([list(map(str, x)) for x in model.measure(texts)])
    assert found[0] == found[1] == found[2]


def test_near_duplicates_fetch_no_text_for_one_common_shingle(spark, monkeypatch):
    """Texts that share one shingle of their first ones by chance, as most do in a large corpus, aren't compared; similar ones are."""
    from tidemark.llm import similar

    asked = []

    def similar_pairs(pairs, texts, width, least):
        asked.append(pairs.count())
        return plain(pairs, texts, width, least)

    plain = similar._similar
    monkeypatch.setattr(similar, "_similar", similar_pairs)
    rows = []
    for k in range(120):  # the shingle of a row and the shingle of a column are shared, the words between are its own
        own = [f"o{k}_{n}" for n in range(30)]
        rows.append((k, " ".join([f"r{k // 2}_{n}" for n in range(5)] + own + [f"c{k % 60}_{n}" for n in range(5)])))
    rows += [(200 + k, rows[k][1] + " end") for k in range(5)]
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=0).collect()}
    assert found == {k: k % 200 for k in found} and len(found) == 125
    assert 5 <= sum(asked) <= 8


def test_near_duplicates_shuffle_texts_once_at_the_end(spark):
    from tidemark.llm import similar

    docs = spark.createDataFrame([(k, f"text {k % 7} of some words more") for k in range(50)] + [(None, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    kept = similar.drop_near_duplicates(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = kept.select("*")._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["doc_id"] for r in kept.select("*").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([*range(7), None, None], key=repr)
    assert plan.count("Exchange hashpartitioning") == 2  # of texts and of the rows that stay
