import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import common, rans, separators
from quantloom.llm.tokens import ChunkEncoder, vocabulary_path

PATH = vocabulary_path()


def library_ids(texts, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    if plain:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t ab'sé1!漢<|>", "<|endoftext|>", "endoftext"]), max_size=30).map("".join), max_size=6), st.booleans())
def test_chunks_encode_as_the_library_does(texts, plain):
    got = [np.frombuffer(b, "<u2").tolist() for b in ChunkEncoder(PATH, 3, plain).encode(texts)]
    assert got == library_ids(texts, plain)


def test_special_tokens_are_ids_of_their_own():
    text = "a <|endoftext|> b"
    own, plain = (np.frombuffer(ChunkEncoder(PATH, plain=p).encode([text])[0], "<u2").tolist() for p in (False, True))
    assert 50256 in own and len(own) == 4 and 50256 not in plain and own == library_ids([text])[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 9), st.integers(1, 5))
def test_rans_round_trip_and_checkpoints(ids, lanes, every):
    ids = np.array(ids, dtype=np.uint16)
    table = rans.Table(rans.quantize(np.bincount(ids, minlength=41)))
    block = rans.encode_block(ids, table, lanes, every)
    assert (rans.decode_block(block, table) == ids).all()
    for bad in ("word", "states"):
        if len(block["checkpoints"]) > 1:
            points = [dict(p) for p in block["checkpoints"]]
            points[1][bad] = points[1][bad] + 1 if bad == "word" else bytes(points[1][bad][:-1]) + bytes([points[1][bad][-1] ^ 1])
            try:
                rans.decode_block(block | {"checkpoints": points}, table)
            except (ValueError, IndexError):
                continue
            raise AssertionError("a damaged checkpoint went unnoticed")
    pieces = [rans.decode_steps(block, table, k, (block["checkpoints"][k + 1 : k + 2] or [{"step": None}])[0]["step"]) for k in range(len(block["checkpoints"]))]
    assert np.concatenate(pieces or [ids[:0]]).tolist() == ids.tolist()


def test_damaged_block_is_noticed():
    ids = np.arange(1000, dtype=np.uint16) % 7
    table = rans.Table(rans.quantize(np.bincount(ids)))
    block = rans.encode_block(ids, table, 8)
    words = bytearray(block["words"])
    words[5] ^= 1
    try:
        rans.decode_block(block | {"words": bytes(words)}, table)
    except (ValueError, IndexError):
        return
    raise AssertionError("no error")


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    at, out = 0, []
    for d, ids in rows:
        ids = [*ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op2_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(list(zip([d for d, _ in rows], library_ids([t for _, t in rows]))))
    got = sorted(map(tuple, rans.op2_rans_token_file(spark, sf).collect()))
    assert got == want


def test_token_file_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    path = common.scratch_path(spark, "t")
    rans.write_token_file(odd, path, block_ids=64, lanes=4)
    got = rans.read_documents(spark, path).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(list(zip([d for d, _ in rows], library_ids([t for _, t in rows])))), key=key)
    raw = rans.read_documents(spark, path, digest=False).where("doc_id = 9").first()
    assert np.frombuffer(raw.ids, "<u4").tolist() == [*library_ids([[t for d, t in rows if d == 9][0]])[0], 0]
    empty = common.scratch_path(spark, "t")
    rans.write_token_file(none, empty)
    assert rans.read_documents(spark, empty).count() == 0


def test_op1_counts_what_the_library_counts(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: len(i) for r, i in zip(rows, library_ids([r.text for r in rows], True))}
    assert {r.doc_id: r.n_tokens for r in separators.op1_separator_token_counts(spark, sf).collect()} == want


def test_documents_across_blocks_and_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, tail in (("a", [7, 7]), ("b", []), ("c", [])):
        ids = np.array([] if name == "c" else [*rng.choice([1, 2, 3, 9], 500, p=[0.4, 0.4, 0.18, 0.02]), 9, *tail], "<u4")
        (tmp_path / name).write_bytes(ids.tobytes())
    got = separators.separator_scan(separators.read_flat_files(spark, f"{tmp_path}/*", 4 * 7), 9, width=4, chunk_blocks=3).collect()
    for name in "abc":
        ids = np.frombuffer((tmp_path / name).read_bytes(), "<u4").tolist()
        want, at = [], 0
        for k, x in enumerate(ids):
            if x == 9:
                want.append((len(want), at, k - at, True))
                at = k + 1
        if at < len(ids):
            want.append((len(want), at, len(ids) - at, False))
        assert sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith(f"/{name}")) == want


def test_a_special_token_in_a_text(spark):
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "plain")], "doc_id long, text string")
    path = common.scratch_path(spark, "t")
    rans.write_token_file(docs, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.read_documents(spark, path).collect())
    assert got == brute(list(zip([1, 2, 3], library_ids(["x <|endoftext|> y", "<|endoftext|>", "plain"]))))


def test_flat_files_of_odd_rows(spark, odd, none):
    path = common.scratch_path(spark, "t")
    separators.write_flat(odd, path, block_bytes=64)
    blocks, order = separators.read_flat(spark, path)
    got = separators.separator_scan(blocks, separators.END_ID, chunk_blocks=2).join(order, ["file", "ordinal"]).collect()
    rows = odd.select("doc_id", "text").collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((r.doc_id, len(i)) for r, i in zip(rows, library_ids([r.text for r in rows], True))), key=key)
    path = common.scratch_path(spark, "t")
    separators.write_flat(none, path)
    assert not separators.separator_scan(separators.read_flat(spark, path)[0], separators.END_ID).count()
