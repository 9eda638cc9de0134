"""Tokens, packing, chat and lines against libraries and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, linededup, packing, queries
from tidemark.llm import sentencepiece_bpe as sp
from tidemark.llm.words import Memory

PIECES, BYTES = queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁x ▁", "<s></s>[INST]", "日本語 été", "\n\n a\tb\r\n", "😀😀 z", "\0 x\0", "a" * 300, "ﬁ ½", "<0x0A> hi", " x", "word " * 3000, "x" * 20000]
TEXT = st.text(st.one_of(st.sampled_from(" ▁\n\tab.,é日😀<|>"), st.characters(exclude_categories=("Cs",))), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    model = sp._model(PIECES)[0]
    ids = np.frombuffer(sp.encode_texts([text], PIECES)[0], np.int32).tolist()
    assert ids == model.library.encode(text, add_eos=True)
    assert model.decode(ids) == model.library.decode(ids)


def test_odd_texts_and_ids():
    model = sp._model(PIECES)[0]
    for t, e in zip(ODD, sp.encode_texts(ODD, PIECES)):
        assert np.frombuffer(e, np.int32).tolist() == model.library.encode(t, add_eos=True)
    r = random.Random(1)
    for _ in range(200):
        ids = [r.choice([r.randrange(300), r.randrange(32000)]) for _ in range(r.randrange(12))]
        assert model.decode(ids) == model.library.decode(ids)


def test_short_and_long_agendas_agree():
    model = sp._model(PIECES)[0]
    r = random.Random(2)
    for _ in range(500):
        word = "▁" + "".join(r.choice("theanoris") for _ in range(r.randrange(1, 30)))
        assert model._merged_short(word) == model._merged_long(word)


def test_memory_keeps_words_over_generations():
    m = Memory(4)
    for words in ({"a", "b", "c"}, {"b", "c", "d", "e"}, {"a", "e"}):
        fresh = m.missing(words)
        m.new.update(dict.fromkeys(fresh, 1))
        assert all(w in m.new for w in words)


def test_encode_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (None, "", "z")], "doc_id long, text string, more string")
    rows = sp.decode(sp.encode(df, PIECES), PIECES).collect()
    assert [(r["doc_id"], len(r["ids"]), r["decoded"]) for r in rows] == [(1, 1, ""), (1, 3, "a b"), (None, 1, "")]
    with pytest.raises(ValueError):
        sp.encode(df.withColumn("ids", F.lit(1)), PIECES)
    assert sp.encode(df.limit(0), PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_bytes_equal_the_library(text):
    t = packing._tokenizer(BYTES)[0]
    assert np.frombuffer(packing.token_bytes([text, text + "<|endoftext|> a"], BYTES)[1], "<u4").tolist() == t.encode(text + "<|endoftext|> a", add_special_tokens=False).ids + [0]
    assert np.frombuffer(packing.token_bytes([text, ""], BYTES)[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [0]


def test_all_characters_and_very_long_texts_split_as_the_library_does():
    t = packing._tokenizer(BYTES)[0]
    every = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 41)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1{c}{c} {c}\n {c}  {c}" for c in every[k : k + 1000]) for k in range(0, len(every), 1000)]
    texts += [" " * 1_000_000, "\n" * 1_000_000, "é" * 300_000, "a b  c\t" * 100_000]
    for text in texts:
        assert np.frombuffer(packing.token_bytes([text], BYTES)[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127)))
def test_ascii_texts_split_as_others_do(text):
    _, _, pieces, ascii_pieces, _ = packing._tokenizer(BYTES)
    assert ascii_pieces.findall(text) == pieces.findall(text)


def test_equal_pieces_of_a_block_are_looked_up_once(monkeypatch):
    class Counted(packing.Pieces):
        asked = 0

        def __getitem__(self, piece):
            Counted.asked += 1
            return super().__getitem__(piece)

        def get(self, piece):
            Counted.asked += 1
            return super().get(piece)

    t, *rest, _ = packing._tokenizer(BYTES)
    monkeypatch.setitem(packing._tokenizers, BYTES, (t, *rest, Counted(t.model)))
    texts = ["word " * 200, None, "a word's été", ""] * 25
    found = packing.token_bytes(texts, BYTES, 7)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [t.encode(x or "", add_special_tokens=False).ids + [7] for x in texts]
    assert Counted.asked <= 20  # 5075 pieces, of which seven are told apart, and the ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("''sStldmrve  9½é\u00a0\u3000\u2028\n\t\0.,日😀ß\U0001d7d8"), max_size=20), min_size=1, max_size=5))
def test_pieces_start_where_the_pattern_says(texts):
    raw = [x.encode() + b"\0" for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = packing.piece_starts(data, np.cumsum([len(x) for x in raw]) - 1).tolist()
    found = [bytes(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)])]
    assert found == [p.encode() for x in texts for p in [*packing._tokenizer(BYTES)[2].findall(x), "\0"]]


def test_new_pieces_are_encoded_together_and_memory_stays_bounded():
    from tokenizers import models

    model = packing._tokenizer(BYTES)[0].model
    known = packing.Pieces(model, most=5)
    for words in ([f" w{k}é\n" for k in range(40)], ["a", " w7é\n", "x" * 200, "\n", "\n\n"], ["a", " w1é\n"]):
        assert known.of(words) == [packing.Pieces(model)[w] for w in words]
        assert len(known) <= 5 and len(known.old) <= 5
    few = models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Pieces(few).of(["ab", "cab", "c", "bcb"])] == [[2], [2], [], [1, 1]]
    assert packing.Pieces(few)["c"] == b""


def test_forgotten_pieces_are_encoded_again():
    t = packing._tokenizer(BYTES)[0]
    known = packing.Pieces(t.model, most=5)
    words = [f" w{k % 17}é" for k in range(100)] + [" " + "x" * 200]
    for w in words:
        assert np.frombuffer(known[w], "<u4").tolist() == t.encode(w, add_special_tokens=False).ids
        assert len(known) <= 5 and len(known.old) <= 5
    assert " " + "x" * 200 not in known


def test_patterns_of_the_linear_program_place_most_items():
    r = np.random.default_rng(7)
    for n in (300, 3000, 100_000):
        rest = (np.exp(r.normal(5.5, 1.2, n)).astype(int) % 1023) + 1
        histogram = dict(zip(*map(np.ndarray.tolist, np.unique(rest, return_counts=True))))
        p = packing.plan(histogram)
        placed = (p.slots[:, 2] - p.slots[:, 1]).sum()
        assert placed >= 0.9 * n
        assert p.end <= rest.sum() // 1024 + 10  # no more sequences than the tokens need, and the last's powers of two


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_without_gaps(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 64, int(r.integers(1, 300)))
    lengths[: len(lengths) // 3] = 41
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    p = packing.plan(histogram, 64)
    parts = defaultdict(list)
    for k, n in histogram.items():
        own = p.slots[p.slots[:, 0] == k]
        for rank in range(n):
            at = own[(own[:, 1] <= rank) & (rank < own[:, 2])]
            if len(at):
                parts[int(at[0, 4] + rank - at[0, 1])].append((int(at[0, 3]), k))
            else:
                first, place = p.loose[k]
                for length, sequence, offset in packing.cut_stream(place + (rank - first) * k, k, p):
                    parts[sequence].append((offset, length))
    for x in parts.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert sum(n for x in parts.values() for _, n in x) == lengths.sum()
    assert sorted(parts) == list(range(p.end))


def test_packing_table(spark):
    texts = [None, "", "a b c", "the quick " * 3000, "x", "a b c", "<|endoftext|> y", "été " * 700] + ["n " * k for k in range(1, 200)]
    df = spark.createDataFrame([(k // 2, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, start string")
    rows = packing.pack(df, BYTES).collect()
    t = packing._tokenizer(BYTES)[0]
    want = sorted((k // 2, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for k, x in enumerate(texts))
    seen, docs = defaultdict(list), []
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc in {r["doc_id"] for r in rows}:
        pieces = sorted(((r["doc_tokens"], r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == doc))
        docs.append((doc, sorted(pieces)))
    assert sum(len(b) for _, b in want) == sum(len(b) for _, p in docs for _, _, b in p)
    for sequence in seen.values():
        end = 0
        for offset, length in sorted(sequence):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    single = [r for r in rows if r["doc_id"] == 1]  # "a b c" and a long one
    assert {r["doc_tokens"] for r in single} == {len(want_) // 4 for k, want_ in want if k == 1}
    assert queries.piece_digests(packing.pack(df.limit(0), BYTES)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("doc_id", "row"), BYTES, id_col="row")


def test_op10_pieces_are_the_documents(spark, sf_dir):
    rows = queries.op10_packing(spark, sf_dir).collect()
    t = packing._tokenizer(BYTES)[0]
    docs = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = docs[r["doc_id"]]
        assert r["start"] == ends[r["doc_id"]] and r["doc_tokens"] == len(ids)
        ends[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert ends == {k: len(v) for k, v in docs.items()}


def test_op2_digests(spark, sf_dir):
    lib = sp._model(PIECES)[0].library
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_sentencepiece(spark, sf_dir).collect():
        ids = lib.encode(docs[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


T = chat.LLAMA_LIKE
PARTS = st.lists(st.sampled_from([*T.controls, *(c[:k] for c in T.controls for k in range(1, len(c))), "\\", "a", " ", "\n"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST] "]), PARTS), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    reader, got = chat.Reader(T), []
    for k, (role, text) in enumerate(turns):
        for part in chat.segments(T, role, text, k == 0):
            got += reader.feed(*part)
    assert [(a, b) for a, b, _ in got] == turns and reader.held == ""
    assert [c for _, _, c in got] == [b if a == "assistant" else "" for a, b in turns]
    for _, text in turns:
        assert not any(c in T.escape(text) for c in T.controls) and T.unescape(T.escape(text)) == text


def test_chat_table(spark, sf_dir):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (None, None, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "tool", "t"), (4, 3, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"], r["valid"]) for k, r in got.items()} == {1: (2, 0, True), 2: (1, 1, False), None: (1, 0, False), 3: (2, 0, False), 4: (4, 1, True)}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    conv = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        conv[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    conv[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = queries.op7_chat(spark, sf_dir).collect()
    assert len(rows) == len(conv)
    for r in rows:
        turns = sorted(conv[r["conv_id"]])
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learnt))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def test_segments_out_of_order_raise(spark):
    rows = [(1, 0, "<s>[INST] ", False, "user"), (1, 2, "x", False, "user"), (1, 1, " [/INST]", False, "user")]
    df = spark.createDataFrame(rows, "conv_id long, segment long, text string, loss boolean, state string").coalesce(1)
    with pytest.raises(Exception, match="should be"):
        chat.read_back(df).collect()
    long = [(5, 0, "user", "u " * 200_000), (5, 1, "assistant", "a\\" * 200_000)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).first()
    assert (got["n_turns"], got["loss_chars"]) == (2, 400_000)


def test_bad_template():
    with pytest.raises(ValueError):
        chat.Template({"user": ("a\\", "b")}, ("x ", "y ", "z "), frozenset(), {}, frozenset())


LINES = ["one line", "two", "three three", "four", "five and so on", "six", "seven", "eight"]


def clean(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    return {(r["doc_id"], r["extra"]): (r["text"], r["removed_lines"]) for r in linededup.remove_repeated(df, **more).collect()}


def test_lines_of_a_shared_passage_go(spark):
    passage = "\n".join(LINES)
    rows = [(1, passage, "a"), (2, "own start\n" + passage + "\nown end", "b"), (3, "only two\nof its own", "c"), (4, None, "d"), (5, "", "e"), (None, "x", "f")]
    got = clean(spark, rows)
    assert got[(1, "a")] == (passage, 0) and got[(3, "c")][1] == 0 and got[(4, "d")] == (None, 0) and got[(5, "e")] == ("", 0)
    text, removed = got[(2, "b")]
    assert removed >= 4 and text.startswith("own start") and text.endswith("own end")


def test_single_short_lines_stay_and_long_ones_go(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a\n{long}\nb", ""), (2, f"c d\n{long}\ne f", ""), (3, "licence line", ""), (4, "licence line", "")]
    got = clean(spark, rows, divisor=1)  # every line is a chunk
    assert got[(2, "")] == ("c d\ne f", 1) and got[(4, "")] == ("licence line", 0)


def test_copies_and_repeats_in_one_text(spark):
    block = "\n".join(LINES)
    got = clean(spark, [(1, block, "a"), (1, block, "b"), (7, block, "c"), (8, block + "\nnew\n" + block, "d")])
    assert got[(1, "a")] == got[(1, "b")] == (block, 0)  # equal id and text are one occurrence
    assert got[(7, "c")][1] == 8 and "new" in got[(8, "d")][0]


def test_chunks_join_to_the_text(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["", "a", "b", "cc"]) for _ in range(r.randrange(1, 40))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", linededup.chunks(F.col("text")).alias("c")).collect():
        assert "\n".join(x["text"] for x in row["c"]) == row["text"]
        assert [x["first"] for x in row["c"]] == np.cumsum([0, *(x["n"] for x in row["c"])])[:-1].tolist()


def test_removed_lines_stand_in_an_earlier_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set()
    for r in sorted(linededup.remove_repeated(docs).collect(), key=lambda r: r["doc_id"]):
        mine = r["text"].split("\n") if r["text"] else []
        gone = before[r["doc_id"]].split("\n")
        for x in mine:
            gone.remove(x)
        kept.update(mine)
        assert len(gone) == r["removed_lines"] or not r["text"]
        assert set(gone) <= kept


def test_very_long_texts_of_lines(spark):
    block = "\n".join(LINES)
    long = "\n".join(f"own {k}" if k % 3 else "same\nsame too" for k in range(6_000))
    got = clean(spark, [(1, block, ""), (2, long, ""), (3, long + "\nlast", "")])
    assert got[(2, "")][1] == 2 * 2_000 - 2 and got[(3, "")][0] == "last"


def test_line_columns_clash(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, removed_lines int")
    with pytest.raises(ValueError):
        linededup.remove_repeated(df)
    assert linededup.remove_repeated(df, removed_col=None).columns == df.columns
    with pytest.raises(ValueError):
        linededup.remove_repeated(df.withColumn("_ld_key", F.lit(1)), removed_col=None)
    assert linededup.remove_repeated(df.limit(0), removed_col=None).count() == 0


def lines_in_earlier_passages(rows, long_words=50):
    """By brute force: for each (id, text) the places of lines in its longest passages that stand in an earlier text, or further up in their own."""
    earlier, out = "\n", {}
    for doc, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for i, line in enumerate(lines):
            above, end = "\n".join(["", *lines[:i], ""]), i
            while end < len(lines) and any("\n".join(["", *lines[i : end + 1], ""]) in x for x in (earlier, above)):
                end += 1
            while end > i and not lines[end - 1].strip():
                end -= 1
            many = sum(1 for x in lines[i:end] if x.strip()) > 1 or len(" ".join(lines[i:end]).split()) >= long_words
            gone |= set(range(i, end)) if line.strip() and many else set()
        earlier += text + "\n\0\n"
        out[doc] = gone
    return out


def test_chunks_find_what_the_complement_is_not_asked_for(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = lambda rows: {(r["_ld_id"], k) for r in rows for k in range(r["start"], r["end"])}
    rows = linededup.repeated(docs).collect()
    by_chunk, by_others = lines(r for r in rows if r["whole"]), lines(r for r in rows if not r["whole"])
    assert len(by_chunk - by_others) > 0.1 * len(by_chunk | by_others) and by_others - by_chunk
    assert all(r["end"] - r["start"] > 1 for r in rows if r["whole"])


def test_first_occurrences_lose_no_line(spark):
    rows = [(1, "a\na\na", ""), (2, "b\nb\nb\nb\nb", ""), (3, "x y\nx y", ""), (4, "p\nq\np\nq\np", ""), (5, "a\na", "")]
    got = clean(spark, rows)
    assert [got[(k, "")] for k in (1, 2, 3, 4, 5)] == [("a\na\na", 0), ("b\nb", 3), ("x y\nx y", 0), ("p\nq", 3), ("", 2)]


def test_every_repeated_passage_goes(spark):
    r = random.Random(9)
    own = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    passages = [[own(r.choice((20, 60, 120))) for _ in range(r.randrange(1, 4))] for _ in range(30)] + [[own(120)], [own(30), "", own(30)]]
    passages = [p for p in passages if len(p) > 1 or len(p[0].split()) >= 50]
    rows = []
    for doc in range(120):  # each passage stands between own lines, of which a text has none to three on each side
        lines = [own(r.choice((1, 8, 42))) for _ in range(r.randrange(4))] + r.choice(passages) + [own(r.choice((1, 8, 42))) for _ in range(r.randrange(4))]
        rows.append((doc, "\n".join(lines)))
    want = lines_in_earlier_passages(rows)
    assert sum(map(len, want.values())) > 120
    got = clean(spark, [(d, t, "") for d, t in rows])
    for doc, text in rows:
        left = [x for i, x in enumerate(text.split("\n")) if i not in want[doc]]
        assert got[(doc, "")] == ("\n".join(left), len(want[doc]))


def test_no_repeated_passage_of_the_table_stays(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"]]
    got = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, sf_dir).collect()}
    for doc, gone in lines_in_earlier_passages(rows).items():
        left = [x for i, x in enumerate(dict(rows)[doc].split("\n")) if i not in gone]
        assert not gone and got[doc]["text"] == dict(rows)[doc] or got[doc]["text"] == ("\n".join(left) if any(x.strip() for x in left) else "")
