"""Manifest, n-gram join and conversation repair against brute force, with the cases that have a defined result of their own."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, merkle, queries, repair
from fixture_tables import tables_in

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (ddl, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({ddl})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return [dict(zip(names, x)) for x in r.fetchall()]


def same_rows(a, b):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))


# ---- the manifest

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def tree_paths(hashes):
    """The root and each leaf's levels of (before, after)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % 16
            paths[k].append((level[first:i], level[i + 1 : first + 16]))
            at[k] = i // 16
        level = [H("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return (level or [""])[0], paths


def brute_manifest(rows):
    leaf = lambda r: H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[1], r[2], r[3], r[4])))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_paths([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, over = tree_paths([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, over):
        for (_, _, h, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            f = leaf((*r[:4], lower)) if bad else h
            for before, after in path + up:
                f = H("".join([*before, f, *after]))
            proof = H("".join(x for b, a in path + up for x in b + a))
            out.append({"doc_id": r[0], "leaf": h, "subroot": trees[s][0], "root": root, "proof_sha256": proof, "folded_root": f, "verified": f == root})
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1, None: 2, "": 3, "é": 15}, {"hot": 600, **{f"s{k}": 2 for k in range(20)}}])
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    r, rows = random.Random(1), []
    for s, n in sizes.items():
        rows += [(len(rows) + k, s, r.choice(["en", None]), r.choice([3, None]), r.choice(["Ab é", "", None, "lower", "X" * 50])) for k in range(n)]
    r.shuffle(rows)
    tables_in(spark, tmp_path, documents=(rows, DOC))
    found = [x.asDict() for x in queries.op11_merkle(spark, str(tmp_path)).collect()]
    want = brute_manifest(rows)
    same_rows(found, want)
    assert {x["verified"] for x in want} == {True, False} or len(rows) < 20
    same_rows(found, in_duckdb(queries.merkle_sql(), documents=(DOC.replace("long", "bigint").replace("string", "varchar"), rows)))


def test_manifest_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(1, "s", "en", 1, "A")] * 20 + [(1, "s", "en", 1, "B"), (2, "s", "en", 9, "Long " * 40000)]
    tables_in(spark, tmp_path, documents=([(*x, "clash", 7) for x in rows], DOC + ", g string, leaf long"))
    same_rows([x.asDict() for x in queries.op11_merkle(spark, str(tmp_path)).collect()], brute_manifest(rows))
    tables_in(spark, tmp_path / "none", documents=([], DOC))
    assert queries.op11_merkle(spark, str(tmp_path / "none")).collect() == []


# ---- the join

def brute_components(texts, width=3, least=0.9):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both * 100 >= least * 100 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_texts(seed, n=120):
    r = random.Random(seed)
    vocabulary, out = [f"w{k}" for k in range(60)], []
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 9, 12, 40, 90]))] for _ in range(12)]
    common = [r.choice(vocabulary) for _ in range(30)]
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words = words + common
        out.append((i, r.choice(["  ", " ", "\t"]).join(words).upper() if r.random() < 0.2 else " ".join(words)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force(spark, seed, monkeypatch):
    texts = near_texts(seed)
    monkeypatch.setattr(jaccard, "LEAST_HOLDERS", (8, 2, 1)[seed])  # whatever counts as common, the links are the same
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)
    monkeypatch.setattr(jaccard, "HOT", (2, 6, 32)[seed])
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", (3, 5, 256)[seed])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_sets(df).collect()}
    assert found == brute_components(texts)
    assert len({c for _, c in found.values()}) < len(texts) - 20


def test_join_on_a_table(spark, sf_dir):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op12_jaccard(spark, sf_dir).collect()}
    assert found == brute_components(rows)


def test_join_chain_over_groups(spark):
    # each text is near the next only: one component, although its ends share little
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join([f"x{j}" for j in range(k)] + words[k:])) for k in range(30)]
    texts += [(100 + k, " ".join([f"y{j}" for j in range(k)] + words[k:])) for k in range(1, 30)]
    found = {x["doc_id"]: x["component_id"] for x in jaccard.near_sets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {i: c for i, (_, c) in brute_components(texts).items()}


def test_join_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(60000))
    rows = [(1, None, 1), (2, "", 2), (3, "  \n", 3), (4, "One two", 4), (5, "one TWO", 5), (6, "one", 6), (7, long, 7), (8, long + " end", 8), (7, "other text", 9), (None, "alone here now", 1), (9, "É a b", 1), (10, "é a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long")
    found = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.near_sets(df).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 59998, 7), (8, 59999, 7), (7, 1, 7), (None, 1, None), (9, 1, 9), (10, 1, 10)]
    assert found == sorted(want, key=repr)
    assert jaccard.near_sets(df.limit(0)).collect() == []


def test_join_of_many_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("a b c d e f")).otherwise(F.concat(F.lit("k " * 40), F.col("id") % 300)).alias("text"))
    found = jaccard.near_sets(df).groupBy("component_id").count().collect()
    assert {(x["component_id"], x["count"]) for x in found} == {(0, 1500), *brute_counts(df)}


def brute_counts(df):
    rows = [(x["doc_id"], x["text"]) for x in df.where("doc_id >= 1500").collect()]
    by = {}
    for _, c in brute_components([(i, t) for i, t in rows if i < 1800]).values():
        by[c] = by.get(c, 0) + 1
    return [(c, 5 * n) for c, n in by.items()]


def test_join_leaves_no_shuffle_files(spark):
    """Each step's files go with the step, not when the driver happens to collect its garbage."""

    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x.split("shuffle_")[1].split("_")[0] for x in found.split("\n") if "shuffle_" in x}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(name, None), shuffles()
    texts = near_texts(7)
    groups = jaccard.near_sets(spark.createDataFrame(texts, "doc_id long, text string"))
    assert spark.conf.get(name, None) == set_before
    end = time.time() + 20
    while len(left := shuffles() - before) > 3 and time.time() < end:  # files go a moment after their step
        time.sleep(0.2)
    assert len(left) <= 3  # a stage that adaptive execution no longer waited for may still have ended
    for _ in range(2):  # what is returned runs again
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in groups.collect()} == brute_components(texts)



def test_join_multiplies_no_rows_that_share_one_common_column(spark, monkeypatch):
    """Texts that share one shingle with many others by chance come to no tile, however many they are; linked ones are found."""
    monkeypatch.setattr(jaccard, "LEAST_HOLDERS", 10**6)  # none is known as common
    monkeypatch.setattr(jaccard, "HOT", 8)
    met, plain = [], jaccard.tiles

    def tiles(*args):
        met.append((out := plain(*args)).count())
        return out

    monkeypatch.setattr(jaccard, "tiles", tiles)
    texts = []
    for k in range(240):  # 25 shingles; three are common, each to a tenth of all texts
        texts.append((k, " ".join(f"r{at}_0 r{at}_1 r{at}_2 " + " ".join(f"o{k}_{at}_{n}" for n in range(6)) for at in (f"a{k % 10}", f"b{k // 24}", f"c{k * 7 % 11}"))))
    texts += [(1000 + k, texts[k][1] + f" end{k}") for k in range(40)] + [(2000 + k, "x " + texts[k][1]) for k in range(40)]
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_sets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == brute_components(texts)
    assert met == [0]


@pytest.mark.parametrize("seed", range(3))
def test_join_whatever_columns_are_hot(spark, seed, monkeypatch):
    """Pairs that share columns of few and of many rows, in any mixture."""
    monkeypatch.setattr(jaccard, "LEAST_HOLDERS", 10**6)
    monkeypatch.setattr(jaccard, "HOT", (1, 3, 12)[seed])
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "first_product", lambda met, least: met.limit(0).selectExpr("node a", "node b"))  # all is left to pairs and tiles
    r, texts = random.Random(seed), []
    lines = [" ".join(f"l{k}_{n}" for n in range(r.choice([3, 5, 12]))) for k in range(14)]
    for k in range(150):
        words = " ".join(r.sample(lines, r.randrange(1, 7))).split() + [f"o{k}_{n}" for n in range(r.choice([0, 2, 20, 60]))]
        for j in range(r.choice([1, 1, 2, 4])):
            texts.append((1000 * j + k, " ".join(words)))
            for _ in range(r.choice([1, 1, 2])):
                words[r.choice([0, -1, r.randrange(len(words))])] = f"n{k}_{j}_{r.randrange(99)}"
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_sets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == brute_components(texts)
    assert len({c for _, c in found.values()}) < len(texts) - 40


# ---- the repair

TURN = "conv_id long, turn long, role string, text string"


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows, by all edits."""
    after = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        after += [(turn is not None, turn or 0, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    after.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
    kinds, seen = [], set()
    for _, _, role, text in after:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for known, t, _, _ in after if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [x[2][:1] for x in after]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # all edits: of each node every audit, without a heap; at most two insertions in a place
    legal = lambda s, x: (x == "s" and s == "") or (x == "u" and s in ("", "s", "a")) or (x == "a" and s == "u")
    level = {("", 0, "", ())}
    for k in range(len(after) + 1):
        for _ in range(2):
            level |= {(x, c + 5, e + "I", out + ((n, ""),)) for s, c, e, out in level for x, n in (("u", "user"), ("a", "assistant")) if legal(s, x)}
        if k == len(after):
            break
        _, _, role, text = after[k]
        more = 5 if kinds[k] == "truncated" else 0
        new = {(s, c + 2, e + "D", out) for s, c, e, out in level}
        if kinds[k] not in ("blank", "duplicate"):
            new |= {(role[:1], c + more, e + "K", out + ((role, text),)) for s, c, e, out in level if legal(s, role[:1])}
            new |= {(x, c + 1 + more, e + "R", out + ((n, text),)) for s, c, e, out in level for x, n in (("u", "user"), ("a", "assistant")) if legal(s, x)}
        bound = 2 * (k + 1) + 12  # deleting all costs two a row; what is dearer than that by more than the rest can't win
        level = {x for x in new if x[1] <= bound}
    cost, audit, out = min((c, e, out) for s, c, e, out in level if s in ("", "a"))
    count = lambda x: sum(k == x for k in kinds)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, H("\n".join(f"{r}:{t}" for r, t in out))


def odd_conversations(seed, n=60):
    r, rows = random.Random(seed), []
    for c in range(n):
        said = [r.choice(["Hello.", "no end", "  ", "", None, "Yes! ", "hm?\n", "Ok.", "é."]) for _ in range(3)]
        for t in range(r.randrange(0, 6)):
            rows.append((c if c else None, r.choice([t, t, t, 2 * t, None]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), r.choice(said + [f"text {c} {t}."])))
    return rows


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed,piece", [(0, 1024), (1, 1), (2, 2), (3, 3)])
def test_repair_equals_brute_force(spark, seed, piece):
    rows = odd_conversations(seed)
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    df = spark.createDataFrame(rows, TURN)
    repaired = repair.repair(repair.damaged(df), piece_rows=piece)
    found = {x["conv"]: tuple(x[c] for c in COUNTS) for x in repair.digests(repaired).collect()}
    assert found == {c: brute_repair(x) for c, x in by.items()}
    turns = {}
    for x in sorted(repair.repaired_turns(repaired).collect(), key=lambda x: (repr(x["conv"]), x["place"])):
        turns.setdefault(x["conv"], []).append(f"{x['role']}:{x['text']}")
    assert {c: H("\n".join(t)) for c, t in turns.items()} == {c: x[-1] for c, x in found.items() if c in turns}
    assert all(x[-1] == H("") for c, x in found.items() if c not in turns)


def test_repair_equals_sql(spark, tmp_path):
    rows = odd_conversations(9, 200)
    tables_in(spark, tmp_path, conversations=([(*x, 1, "x") for x in rows], TURN + ", cost long, conv string"))
    found = [x.asDict() for x in queries.op13_repair(spark, str(tmp_path)).collect()]
    same_rows(found, in_duckdb(queries.repair_sql(), conversations=(TURN.replace("long", "bigint").replace("string", "varchar"), rows)))


def test_repair_of_one_long_conversation(spark):
    """One conversation over many ranges and pieces gives what one piece gives."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"t{t}!"])) for t in range(1500)]
    df = spark.createDataFrame(rows, TURN).repartition(4)
    short = repair.digests(repair.repair(repair.damaged(df), piece_rows=40)).collect()
    kinds = repair.damaged(df).collect()
    assert len(short) == 1 and len(short[0]["audit"]) >= sum(x["times"] for x in kinds)
    con = in_duckdb(queries.repair_sql(), conversations=(TURN.replace("long", "bigint").replace("string", "varchar"), rows))
    assert {c: short[0][c] for c in COUNTS} == {c: con[0][c] for c in COUNTS}


def test_repair_odd_rows(spark):
    empty = spark.createDataFrame([], TURN)
    assert repair.digests(repair.repair(repair.damaged(empty))).collect() == []
    rows = [(1, 1, "user", "x. " * 200000)] * 50 + [(1, 2, "assistant", "y.")] * 3
    (x,) = repair.digests(repair.repair(repair.damaged(spark.createDataFrame(rows, TURN)))).collect()
    assert x["cost"] == 2 * (x["duplicate"] + x["blank"]) and x["audit"].count("K") == 2
    dropped = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (x,) = repair.digests(repair.repair(repair.damaged(spark.createDataFrame([(*dropped, "user", "a.")], TURN)))).collect()
    assert tuple(x[c] for c in COUNTS) == (0, 0, 0, 0, 0, 0, "", H(""))
