import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, token_orc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["it's <|endoftext|> x<|startoftext|>y ΑΣ ΟΔΟΣ İstanbul á́ \x1c \x1d word\x85x 12345 !!!???.... don't we'll'll", "", "   ", "　 a   b\n\n c", "naïve café ﬁ Ω ½ ²³ 漢字かな😀😀 \t\t x", "a" * 3000 + " " + "ab" * 2000 + "!?" * 999, "'s't're", "<|endoftext|", "<|endoftext|>", "x  y", " lead", "trail ", "tab\tword\n word"]


def texts():
    rng = random.Random(6)
    parts = ["the", "Ing", "tion", "é", "ß", " ", " ", " ", "\n", ".", ",", "'s", "99", "漢", "́", "!!", "\xa0", "queue", "zz", "-"]
    return HARD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(300)] + ["long " + "word piece " * 40_000]


def test_transducer_equals_the_library_and_decodes():
    own, lib = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        raw = own.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids, t[:80]
        assert own.decode(raw).decode() == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_split_and_lowered_as_the_library_does():
    own, lib = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    points = [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]
    for k in range(0, len(points), 20_000):
        words = [f"a{chr(c)}b K{chr(c)}" for c in points[k : k + 20_000]]
        ids = [e.ids for e in lib.encode_batch(words, add_special_tokens=False)]
        assert np.frombuffer(own.encode("\n".join(words)), "<u4").tolist() == [i for e in ids for i in e], (k, [w for w, e in zip(words, ids, strict=True) if np.frombuffer(own.encode(w), "<u4").tolist() != e][:5])


def test_long_words_are_encoded_slice_by_slice():
    own, lib = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(8)
    for parts in (["ab", "'", "l", "9", "!"], ["漢", "字", "か", "゙", "か"], ["é", "e", "́", "K", "x"], ["가", "ᄀ", "ᅡ", "ᆨ"], ["'s", "'", "'ll", "!", "\xa0", "t"]):
        for _ in range(2):
            text = "".join(rng.choice(parts) * rng.choice((1, 1, 1, 40)) for _ in range(900))
            assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_transducer_emits_before_the_end_and_keeps_little():
    machine = bpe.WordTokenizer(WORD).machine
    rng = random.Random(7)
    piece = "".join(rng.choice("abcdefgh") for _ in range(2000))
    fed = 0

    def stream():
        nonlocal fed
        for c in [*piece[:-1], piece[-1] + "</w>"]:
            fed += 1
            yield c

    out, lag = [], []
    for token in machine.tokens(stream()):
        out.append(token)
        lag.append(fed - sum(len(machine.parts[t]) for t in out))
    assert out == machine.merged([*piece[:-1], piece[-1] + "</w>"])
    assert max(lag) <= 3 * machine.lookahead


def test_incremental_decoder_restores_text():
    own = bpe.WordTokenizer(WORD)
    assert own.read(own.encode("naïve 漢字 word")) == "naïve 漢 字 word ".replace("漢 字", "漢字")
    decoder = bpe.ByteDecoder()
    assert "".join([decoder.feed(bytes([b])) for b in "a漢😀é".encode()]) + decoder.close() == "a漢😀é"
    machine = bpe.ByteDecoder("")
    symbol = bpe.byte_symbols()
    assert "".join([machine.push(symbol[b]) for b in "a漢😀".encode()]) + machine.close() == "a漢😀"


@pytest.fixture
def rows(spark):
    data = [(i * 7 % 1009, t, "n") for i, t in enumerate([None, *texts()])]
    return data, spark.createDataFrame(data, "doc_id long, text string, n_tokens string")


def test_bpe_query_columns(rows):
    data, frame = rows
    own, lib = bpe.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_documents(frame, WORD).collect()}
    for i, t, _ in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].text_sha256 == hashlib.sha256(own.read(np.array(ids, "<u4").tobytes()).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_orc_round_trip(spark, rows, tmp_path):
    data, frame = rows
    lib = Tokenizer.from_file(BYTE)
    path = f"file://{tmp_path}/tokens"
    token_orc.write_tokens(frame, path, BYTE, partitions=5)
    tokens = token_orc.read_tokens(spark, path)
    got = {r.doc_id: r for r in token_orc.digest(tokens).collect()}
    start = 0
    for i, t, _ in sorted(data):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in tokens.sort("part", "offset").select("doc_id").collect()] == sorted(i for i, *_ in data)
    assert tokens.where("doc_id = 7").count() == 1


def test_orc_files_have_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    import pyarrow.orc

    frame = spark.range(9000).selectExpr("id * 2 as doc_id", "concat('word ', id) as text")
    token_orc.write_tokens(frame, f"file://{tmp_path}/t", BYTE, partitions=2)
    files = sorted(tmp_path.glob("t/*.orc"))
    assert len(files) == 2 and sum(pyarrow.orc.ORCFile(f).nrows for f in files) == 9000
    jvm = spark.sparkContext._jvm
    for f in files:
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), options)
        assert reader.getRowIndexStride() == token_orc.INDEX_STRIDE
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        assert "BLOOM_FILTER_UTF8" in {str(x.getKind()) for x in footer.getStreamsList()}
    tokens = token_orc.read_tokens(spark, f"file://{tmp_path}/t")
    plan = tokens.where("doc_id = 7000")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7000)]" in plan
    assert tokens.where("doc_id = 7000").count() == 1 and tokens.where("doc_id = 7001").count() == 0


def test_byte_parts_equal_the_library():
    lib, memo = Tokenizer.from_file(BYTE), token_orc.PartMemo(BYTE)
    from corpusloom.llm.arrow_text import pieces
    import pyarrow as pa

    rng = random.Random(9)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u3000", "a", "Zb", "é", "漢", "1", "22", ".", "!?", "'", "'s", "'LL", "<|endoftext|>", "<", "|", ">", "\x1c", "\x85", "\x00", "٣"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(6000)] + texts()
    got = []
    for _, _, offsets, data in pieces(pa.array(values), 1 << 16):
        ids, bounds = memo.encode(data, offsets, 0)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for v, e, g in zip(values, lib.encode_batch(values, add_special_tokens=False), got, strict=True):
        assert g == [*e.ids, 0], v[:100]


def test_empty_and_repeated(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_orc.write_tokens(none, f"file://{tmp_path}/none", BYTE)
    assert token_orc.digest(token_orc.read_tokens(spark, f"file://{tmp_path}/none")).count() == 0
    assert bpe.encode_documents(none, WORD).count() == 0
    twice = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a"), (None, "z")], "doc_id long, text string")
    token_orc.write_tokens(twice, f"file://{tmp_path}/twice", BYTE, partitions=2)
    got = sorted(r.start for r in token_orc.digest(token_orc.read_tokens(spark, f"file://{tmp_path}/twice")).collect())
    assert got == [0, 2, 4, 6]
