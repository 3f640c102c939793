"""Operators 3, 4, 8 and 9 against brute force, and their awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import CLASHING, corpus, frame, prose
from watchtide.llm import bpe, common, decontaminate, exact_dedup, token_planes


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for n, span in ((0, 10), (1, 1), (5, 1 << 44), (1000, 1 << 30), (300, 400)):
        values = np.sort(rng.choice(span, n, replace=False).astype(np.uint64)) if span < 1000 else np.unique(rng.integers(0, span, n, dtype=np.uint64))
        width = common.rice_width(span, len(values))
        assert (common.rice_decode(common.rice_encode(values, width), len(values), width) == values).all()


def test_exact_dedup(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts), prints_per_owner=16).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for text, members in groups.items():
        for i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(members), len(members), i == max(members))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_null_and_repeated_ids(spark):
    rows = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b", "b", None, "c"], [None, 3, 7, 7, None, None])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in rows) == [
        (-1, -1, 1), (-1, -1, 1), (-1, 3, 2), (3, 3, 2), (7, 7, 2), (7, 7, 2)]
    assert sum(r["kept"] for r in rows) == 4
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def edit_distance_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(pattern, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (w != x)))
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(300):
        pattern = [rng.choice("abcd") for _ in range(rng.randrange(1, 80))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert decontaminate.myers(pattern, text)[0] == edit_distance_anywhere(pattern, text)


def test_matches_against_brute_force(spark):
    rng = random.Random(2)
    items = [prose(rng, n, 3000) for n in (9, 30, 33, 70, 120)] + ["too short", None, "", "- -"]
    texts = [None, "", "nothing here", "Too, SHORT!", "this is too short of course"]
    for item in items[:5]:
        words = item.split()
        for edits in (0, 2, len(words) // 8, len(words) // 2):
            own = list(words)
            for k in rng.sample(range(len(own)), edits):
                own[k] = rng.choice(["zzz", ""]) if rng.random() < 0.7 else own[k] + " extra"
            texts.append(f"{prose(rng, 50, 3000)} {' '.join(own).upper()}!! {prose(rng, 20, 3000)}")
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(items)], "item_id long, text string, doc_id string, passages int")
    want = set()
    for d, t in enumerate(texts):
        words = decontaminate.plain(t or "").split()
        for i, item in enumerate(items):
            own = decontaminate.plain(item or "").split()
            if len(own) < decontaminate.LEAST_WORDS:
                if own and own == words:
                    want.add((d, i))
            elif any(edit_distance_anywhere(p, words) <= int(decontaminate.RATE * len(p)) for p in decontaminate.passages(own)):
                want.add((d, i))
    for block_bytes in (decontaminate.BLOCK_BYTES, 300):
        got = decontaminate.matches(frame(spark, texts), bench, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert (3, 5) in want and len(want) > 10
    assert decontaminate.matches(frame(spark, []), bench).collect() == []
    assert decontaminate.matches(frame(spark, texts), bench.where("false")).collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # untouched


@pytest.mark.parametrize("planes, block_ids", [("byte", 1 << 16), ("bit", 64), ("byte", 50)])
def test_token_files_round_trip(spark, library, planes, block_ids):
    texts = corpus()
    path = common.shared_path(spark, "tokens")
    token_planes.write(frame(spark, texts), path, public_tokenizers.path("byte_bpe_50k.json"), planes=planes, block_ids=block_ids, file_bytes=2000)
    got = {r["doc_id"]: r for r in token_planes.read(spark, path).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(got[i]["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(texts)


def test_token_files_awkward(spark):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = common.shared_path(spark, "tokens")
    token_planes.write(frame(spark, []), path, tokenizer)
    assert token_planes.read(spark, path).collect() == []
    path = common.shared_path(spark, "tokens")
    token_planes.write(frame(spark, ["b", "a", "n", None], [5, 5, None, -3]), path, tokenizer)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_planes.read(spark, path).collect())
    assert rows == [(0, None, 2), (2, -3, 1), (3, 5, 2), (5, 5, 2)]


def test_word_ids_equal_whole_text_ids(library):
    encode = token_planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "9", "é", "　", " ", "\r", "!!", "<|endoftext|>", "\x1e", "\x85", "Ünï", "×", "_", "&&&", "don't", "²", "ª", "ß,"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    assert np.frombuffer(encode(["a <|endoftext|> b"])[0], "<u4").tolist() == library.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids or library.token_to_id("<|endoftext|>") != 50256


def test_plain_texts_are_cut_into_pieces_that_are_encoded_once(library, monkeypatch):
    encode = token_planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    alphabet = ["a", "The", " ", " ", "  ", "\n", "'s", "'", "'ll", "'RE", "'t", "2024", "é", "ÀB", "ÿ", "!!", "-", "~", "don't", ", ", "x" * 70]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    whole = []
    monkeypatch.setattr(encode, "_whole", lambda t: whole.append(t) or token_planes.Encoder._whole(encode, t))
    assert encode(texts) == want and not whole
    monkeypatch.setattr(token_planes, "KNOWN_WORDS", 5)  # words leave the memory and come back
    assert encode(texts) == want and not whole
    assert max(map(len, encode.known), default=0) <= token_planes.KNOWN_LETTERS


def test_ids_stay_where_files_are_read(spark):
    texts = corpus()
    path = common.shared_path(spark, "tokens")
    token_planes.write(frame(spark, texts), path, public_tokenizers.path("byte_bpe_50k.json"), file_bytes=2000)
    found = token_planes.read(spark, path, F.crc32("ids").alias("crc"))
    assert found.columns == ["doc_id", "start", "n_tokens", "crc"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Join" in above and "ids#" not in above[:above.rindex("Exchange")]
    whole = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_planes.read(spark, path).collect()}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == whole and len(whole) == len(texts)


def test_bpe_against_the_library(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    texts = corpus() + ["x" * 5000, "word " * 3000, " \n" * 400 + "end"]
    enc = bpe.encoding(ranks, pattern)
    coded = bpe.encode(frame(spark, texts), ranks, pattern, piece_chars=50)
    got = {r["doc_id"]: r for r in bpe.decode(coded, ranks, pattern).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.decode(bpe.encode(frame(spark, []), ranks, pattern), ranks, pattern).collect() == []


def test_round_trip_is_encode_and_decode(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = frame(spark, [*corpus(), "word " * 3000, None, ""])
    want = bpe.decode(bpe.encode(docs, ranks, pattern, piece_chars=50, keep=("lang", "text")), ranks, pattern)
    found = bpe.round_trip(docs, ranks, pattern, piece_chars=50, keep=("lang", "text"))
    assert found.dtypes == want.dtypes
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    assert bpe.round_trip(docs.where("false"), ranks, pattern).collect() == []


def test_safe_pieces_random():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "9", "é", " ", "\r", "!!"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        cut = list(bpe.pieces(text, rng.randrange(1, 8)))
        assert "".join(cut) == text
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_clashing_columns_are_there(spark):
    assert set(CLASHING) <= set(frame(spark, ["a"]).columns)
    assert frame(spark, ["a"]).select(F.col("sha")).first()[0] == "x"


def test_short_items_unspaced_scripts_and_excerpts(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(60)]
    items = ["Who wrote it first?", "\u4f60\u597d\u5417\u4eca\u5929", " ".join(words), "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u3067\u3059\u306d", "of it"]
    before, after = prose(rng, 20), prose(rng, 20)
    texts = [f"{before} who wrote IT, first {after}", f"{before} who wrote it at first {after}", f"\u6211\u8bf4{items[1]}\u3002{after}",
             f"{before} {' '.join(words[12:48])} {after}", f"{before} {items[3][:3]}\u5929\u6c14{items[3][5:]} {after}", f"{before} of it {after}",
             f"{before} {' '.join(words[20:32])} {after}"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 0), (2, 1), (3, 2), (4, 3)}
