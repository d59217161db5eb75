import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwhy.llm import bpe_chunks, language, packing, quality_model, quality_rules
from sparkwhy.llm.queries import ORACLE_SQL, QUERIES
from sparkwhy.llm.shingles import WordHashes, hash_words
from sparkwhy.llm.tokenizing import default_path, load
from tests.duck import connect, same_rows

BPE = load(default_path())
EXTRA = ["", "a", "<|endoftext|>", "x<|endoftext|> y " * 200, "日本語 テキスト　です。" * 300, "a" * 20_000, " " * 5000, "é" * 3000 + " " + "é" * 2000, "   x " * 900, "\n\n\n  a  " * 800, "it's we'll 'x' 's"]


def exact(text):
    return BPE.exact.encode(text, add_special_tokens=False).ids


def test_fast_characters_are_split_alike_by_both_libraries():
    for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        for text in (chr(c), f"a{chr(c)}b", f" {chr(c)} x", chr(c) * 3 + " a1" + chr(c), f"it's{chr(c)}'s {chr(c)}{chr(c)}  \n{chr(c)}"):
            assert BPE.encode(text).tolist() == exact(text), hex(c)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab \n\t'sé1.,日\u00a0\u3000", "<|endoftext|>", " word"]), max_size=600).map(lambda t: "".join(t) * 9))
def test_chunked_ids_are_those_of_the_whole_text(text):
    encoder = bpe_chunks.ChunkEncoder(default_path())
    assert encoder(text).tolist() == exact(text) and not encoder.disagreed


def test_joins_that_disagree_are_repaired():
    """Chunks whose kept ids are wrong at their ends are noticed at the join."""
    text = " ".join(f"word{k}" for k in range(2000))
    for at in (0, -1):
        encoder = bpe_chunks.ChunkEncoder(default_path())
        assert encoder(text).tolist() == exact(text) and not encoder.disagreed
        for raw, made in list(encoder.own.items()):
            if made and len(made[1]):
                wrong = made[1].copy()
                wrong[at] += 1
                encoder.own[raw] = (made[0], wrong, *made[2:])
        assert encoder(text).tolist() == exact(text) and encoder.disagreed == 1


def test_chunks_join_to_the_text_and_are_shared():
    random.seed(2)
    passage = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(random.randrange(999)) for _ in range(900))
    a, b = ("first " * 37 + passage).encode(), ("another start " * 51 + passage).encode()
    assert b"".join(bpe_chunks.cut(a)) == a and len(set(bpe_chunks.cut(a)) & set(bpe_chunks.cut(b))) >= 5
    for c in bpe_chunks.cut("é日😀".encode() * 4000):
        c.decode()
    encoder = bpe_chunks.ChunkEncoder(default_path(), memory=2000)  # forgets all the time
    assert encoder(a.decode()).tolist() == exact(a.decode())


def test_encode_and_decode_equal_the_library(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + EXTRA
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 16_384):
        coded = bpe_chunks.bpe_encode(table, most_shared=most)
        for r in coded.collect():
            ids = np.frombuffer(bytes(r["ids"]), np.uint32).tolist()
            assert ids == exact(texts[r["doc_id"]])
            assert r["decoded"] == BPE.exact.decode(ids, skip_special_tokens=False) == texts[r["doc_id"]]
    assert {r["doc_id"]: r["text"] for r in bpe_chunks.bpe_decode(coded).collect()} == dict(enumerate(texts))


def test_bytes_that_are_no_text_decode_like_the_library():
    for ids in ([255, 200, 64], [161, 50256, 220], list(range(256))):
        assert BPE.decode(np.array(ids, np.uint32)) == BPE.exact.decode(ids, skip_special_tokens=False)


def test_files_that_are_not_byte_level_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        load(default_path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="byte-level"):
        bpe_chunks.bpe_encode(spark.createDataFrame([(1, "A b")], "doc_id long, text string"), path=default_path("word_bpe_49k.json"))


def test_op2(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe_chunks"](spark, sf).collect():
        ids = exact(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# Packing


def best_fit(lengths, capacity):
    """One piece after the other, into the fullest sequence that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once_and_no_more_than_best_fit(lengths):
    counts = np.bincount(lengths, minlength=65)
    made = packing.plan(counts, 64)
    assert (sum((np.bincount(p, minlength=65) * k for p, k in made), np.zeros(65, int)) == counts).all()
    assert all(sum(p) <= 64 and k > 0 for p, k in made)
    assert -(-sum(lengths) // 64) <= sum(k for _, k in made) <= best_fit(lengths, 64)


@pytest.mark.parametrize(("lengths", "total", "one", "two", "three"), [([5, 5, 3, 2], 10, None, (5, 5), (5, 3, 2)), ([4, 4, 4], 12, None, None, (4, 4, 4)), ([4, 4], 12, None, None, None), ([9, 1, 10], 10, (10,), (9, 1), None), ([5], 10, None, None, None)])
def test_index_of_sums(lengths, total, one, two, three):
    index = packing.SumIndex(np.bincount(lengths, minlength=16))
    assert (index.one(total), index.two(total), index.three(total)) == (one, two, three)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(2, 40))
def test_index_finds_a_sum_if_there_is_one(lengths, total):
    counts = np.bincount(lengths, minlength=41)
    index = packing.SumIndex(counts)
    for n, found in ((1, index.one(total)), (2, index.two(total)), (3, index.three(total))):
        there = any(sum(c) == total for c in itertools.combinations(sorted(lengths), n)) if len(lengths) < 25 or n < 3 else found is not None
        assert (found is not None) == there
        assert not found or (sum(found) == total and all(counts[x] >= found.count(x) for x in found))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_op3_equals_a_plain_version_and_fills_gaps_exactly(spark, sf, name):
    """Every piece is where it should be, and most sequences are exactly full, which best fit alone does not aim at."""
    directory = f"{sf.rpartition('/')[0]}/{name}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    expected = set()
    for i, text in texts.items():
        ids = np.array([*BPE.encode(text).tolist(), 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 1024)])):
            expected.add((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = QUERIES["op3_best_fit_packing"](spark, directory).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        ends = [a + n for a, n in sorted(found)]
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 1024
    bound = -(-sum(r["length"] for r in rows) // 1024)
    assert bound <= len(places) <= best_fit([r["length"] for r in rows], 1024) and len(places) <= bound + max(1, 0.003 * bound)
    joined = [f for f in places.values() if len(f) > 1]
    assert sum(sum(n for _, n in f) == 1024 for f in joined) > 0.5 * len(joined)


def test_pieces_without_a_place(spark):
    rows = [(1, 0, 512), (1, 1, None), (None, 0, 512), (2, 0, 0), (2, 1, 1025), (1, 0, 512)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    found = packing.pack(table).collect()
    assert sorted((str(r["doc_id"]), r["piece"]) for r in found if r["sequence_id"] is None) == [("1", 1), ("2", 0), ("2", 1)]
    assert len({(r["sequence_id"], r["offset"]) for r in found if r["sequence_id"] is not None}) == 3
    assert packing.pack(table.limit(0)).collect() == []
    ids = spark.createDataFrame([(0, 4, b"bb"), (0, 0, b"aaaa"), (None, 0, b"x"), (1, 0, None)], "sequence_id long, offset long, ids binary")
    assert [tuple(r) for r in packing.sequences(ids).collect()] == [(0, b"aaaabb")] and packing.sequences(ids.limit(0)).count() == 0


def test_complements_of_one_two_and_three_pieces():
    counts = np.zeros(11, int)
    for n in (7, 3, 6, 2, 2, 5, 1, 2, 2, 10):
        counts[n] += 1
    made = packing.plan(counts, 10)
    assert sum(k for _, k in made) == 4 and all(sum(p) == 10 for p, _ in made)


def test_pieces_of_one_length_get_all_places(spark):
    """Most pieces have one length, so that ranks come from many buckets."""
    rows = [(k, 0, 512 if k % 10 else 100 + k % 7) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(7)
    found = packing.pack(table).collect()
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(found) == 3000
    for parts in places.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(places) <= 1.01 * -(-sum(r[2] for r in rows) // 1024) + 1


def test_sequences_hold_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = packing.pack_documents(docs, with_ids=True).cache()
    joined = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), np.uint32) for r in packing.sequences(packed).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in packed.collect():
        part = joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist()
        assert part == (exact(texts[r["doc_id"]]) + [2])[r["start"] : r["start"] + r["length"]]
    assert sum(map(len, joined.values())) == sum(len(exact(t)) + 1 for t in texts.values())


# Languages and quality


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n).astype(int)
        distance = (code.shape[1] - code @ code.T) // 2
        assert (distance[~np.eye(n, dtype=bool)] >= (1 if n == 2 else 2)).all() and (np.abs(code.sum(0)) < n).all()
    assert language.codewords(1).shape == (1, 0)


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify_held_out(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95


def test_op5_equals_a_plain_version(spark, sf):
    """Every row's language and score by n-grams counted one by one and losses summed class by class."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs.where("pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), 4) != 2"), id_col="doc_id")
    rows = {r["doc_id"]: r for r in QUERIES["op5_output_codes"](spark, sf).collect()}
    mask = 2**32 - 1
    for r in docs.collect():
        assert rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        letters = [ord(c) if c.isalpha() or ord(c) >= 0x250 else 32 for c in (r["text"] or "").lower()]
        s = [32, *[c for k, c in enumerate(letters) if not (c == 32 and k and letters[k - 1] == 32)], 32]
        counts = {}
        for k in range(len(s)):
            h = s[k] * 0x9E3779B1 & mask
            grams = [h]
            if k + 1 < len(s):
                h = (h ^ (s[k + 1] * 0x85EBCA77 + 1 & mask)) * 0xC2B2AE3D & mask
                grams.append(h)
            if k + 2 < len(s):
                grams.append((h ^ (s[k + 2] * 0x27D4EB2F + 2 & mask)) * 0x165667B1 & mask)
            for g in grams:
                counts[g >> 20] = counts.get(g >> 20, 0) + 1
        total = sum(counts.values())
        margin = sum((np.sqrt(n / total) * model.weights[g].astype(float) for g, n in counts.items()), np.array(model.bias, float))
        loss = [sum(w * np.log1p(np.exp(-m * b)) for m, b, w in zip(margin, word, model.trust, strict=True)) for word in model.code.astype(float)]
        p = np.exp(-model.sharp * (np.array(loss) - min(loss)))
        assert rows[r["doc_id"]]["lang_pred"] == model.classes[int(np.argmin(loss))]
        assert abs(rows[r["doc_id"]]["score"] - p.max() / p.sum()) < 1e-3


def test_many_languages_by_random_codes():
    rng = np.random.default_rng(3)
    alphabets = {f"l{k}": [chr(97 + (k * 3 + j) % 26) for j in range(6)] for k in range(8)}
    make = lambda k: " ".join("".join(rng.choice(alphabets[k], 5)) for _ in range(30))
    texts, names = zip(*[(make(k), k) for k in alphabets for _ in range(25)], strict=True)
    model = language.fit(list(texts), list(names))
    assert np.mean([model.predict(make(k))[0] == k for k in alphabets for _ in range(10)]) >= 0.95


def test_held_out_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_model.score_held_out(docs, labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) >= 0.9


def test_op9_equals_a_plain_version(spark, sf):
    """Every row's score by word vectors added one by one and a network written out."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    v, net = model.vectors, model.network
    rows = {r["doc_id"]: r for r in QUERIES["op9_random_indexing"](spark, sf).collect()}
    for r in docs.collect():
        words = (r["text"] or "").split()
        pooled, shaped, echo = np.zeros(v.size), np.zeros(v.size), 0
        for k, word in enumerate(words):
            pooled += v.words[v.word_row.get(word, 0)]
            pieces = quality_model.shape_pieces(word)
            shaped += sum(v.shapes[v.shape_row.get(p, 0)].astype(float) for p in pieces) / len(pieces)
            echo += k > 0 and word == words[k - 1]
        n = max(len(words), 1)
        echo /= max(len(words) - 1, 1)
        x = np.concatenate([pooled / n, shaped / n + echo * v.shapes[1], [echo, np.log1p(len(words)) / 10]])
        x = x if words else np.zeros(len(x))
        hidden = [math.tanh(sum((x - net.mean) / net.scale * net.w[:, j]) + net.b[j]) for j in range(len(net.b))]
        score = 1 / (1 + math.exp(-(sum(h * c for h, c in zip(hidden, net.v, strict=True)) + net.c[0]) / net.temperature))
        found = rows[r["doc_id"]]
        assert abs(found["score"] - score) < 1e-3 and found["predicted"] == int(found["score"] >= 0.5)
        assert found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_index_vectors_and_shapes():
    v = quality_model.index_vector("word", 96)
    assert sorted(np.unique(v)) == [-1, 0, 1] and np.abs(v).sum() == 8 and (v == quality_model.index_vector("word", 96)).all()
    assert [quality_model.shape(w) for w in ("Word", "WORD!!", "a1", "|", "x$$$")] == ["Xx+", "X+!+", "x0", "|", "x$+"]


def test_all_of_a_text_without_spaces_bears_on_its_vector():
    joined = lambda x, n: "word" * 20 + x * n
    model = quality_model.Vectors([joined("。字", 40), joined("-7", 40)] + ["plain words here now"] * 9)
    pools = [model.pool(joined(x, 40)) for x in ("。字", "-7")]
    assert np.abs(pools[0] - pools[1]).max() > 0.01
    assert (model.pool("here " + "y" * 500) == model.pool("here " + "y" * 5)).all()


# Rules


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


COMMON = "Accept our cookies and read the terms of this fine site today please now"


def judged(spark, rows, **limits):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r["doc_id"]: r for r in quality_rules.quality_rules(table, **limits).collect()}


def own(k, n=40):
    return " ".join(f"own{k}x{j}" for j in range(n))


def test_lines_above_the_limit_deplete_a_document(spark):
    rows = [(k, f"{COMMON}\n{own(k)}", "a") for k in range(30)] + [(100, COMMON, "a"), (101, f" {COMMON.upper()}  \n{COMMON}", "a"), (102, COMMON, "b")]
    rows += [(200 + k, own("same"), "c") for k in range(60)]
    found = judged(spark, rows)
    assert found[0]["kept"] and found[0]["n_words_left"] == 40
    assert not found[100]["kept"] and not found[100]["base_failed"] and found[100]["n_words_left"] == 0 and not found[101]["kept"]
    assert found[102]["kept"]  # another host
    assert all(found[200 + k]["kept"] for k in range(60))  # copies have no text of their own


def test_limits_count_documents_of_the_host(spark):
    """More than 4 documents and more than a twentieth of them; rows that are equal count once."""
    for n, of, times, above in ((4, 20, 1, False), (5, 20, 1, True), (4, 20, 5, False), (5, 100, 1, False), (6, 100, 1, True)):
        rows = [(k, f"{COMMON}\n{own(k)}" if k < n else own(k), "a") for k in range(of) for _ in range(times)]
        assert (judged(spark, rows)[0]["n_words_left"] == 40) == above, (n, of, times)


def test_near_copies_do_not_make_their_text_boilerplate(spark):
    """Of 40 near copies of a page, one line is another in each; the line they share with other pages goes, the page stays."""
    page = [own(f"page{j}", 12) for j in range(9)]
    near = [(k, "\n".join([COMMON, *page[: k % 9], own(k, 12), *page[k % 9 + 1 :]]), "a") for k in range(40)]
    other = [(100 + k, f"{own(100 + k)}\n{COMMON}", "a") for k in range(20)]
    found = judged(spark, near + other)
    assert all(found[k]["kept"] and found[k]["n_words_left"] == 108 for k in range(40))
    assert all(found[100 + k]["n_words_left"] == 40 for k in range(20))
    without = {r["doc_id"]: r["text"] for r in quality_rules.without_common_lines(spark.createDataFrame(near + other + [(None, None, "a"), (7000, COMMON, "a")], "doc_id long, text string, source string")).collect()}
    assert all(without[i] == text.replace(f"{COMMON}\n", "").replace(f"\n{COMMON}", "") for i, text, _ in near + other)
    assert without[None] is None and without[7000] == "" and len(without) == 62


def test_lines_of_the_test_tables_are_removed(spark, sf):
    """In both tables, the query's limits take lines from documents, and the texts without them have the words left."""
    for name, least in (("sf0.001", 0), ("sf0.01", 80)):
        directory = f"{sf.rpartition('/')[0]}/{name}"
        docs = spark.read.parquet(f"{directory}/documents.parquet")
        rows = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, directory).collect()}
        assert sum(r["n_words_left"] < r["n_words"] for r in rows.values()) >= least
        for r in quality_rules.without_common_lines(docs).collect():
            assert len(r["text"].encode().split()) == rows[r["doc_id"]]["n_words_left"]


@pytest.mark.parametrize(("text", "n"), [("a b c d e a b c d e", 10), ("a b c d e f a b c d e", 10), ("x x x x x x", 6), ("a b c d e f g", 0), ("a b c d", 0)])
def test_repeated_words(text, n):
    assert quality_rules.repeated_words(hash_words(text.encode().split(), WordHashes())) == n
