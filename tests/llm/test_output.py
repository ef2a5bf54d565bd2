"""Fill-in-middle, token-id output and Merkle manifest against plain Python, with nulls, repeats, ties, long texts and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import fill_in_middle, merkle, mixing_coder, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tie string, output string, path string, block long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", " ", "\n", "\n\n", "don't", "x²", "ß-ü", "日本", "1,234.5", "\t", "  ", " ", "\x1c", "<|endoftext|>", "’s", "🙂"]
    texts = [None, "", "\n", "no end", "a\nb", "a\n\nb\n", "with <S> inside\nx", "<", "é\n" * 40, "X" * 5000, "\r\nx\r\n", "<|endoftext|>", "a  <|endoftext|> b"]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["".join(rng.choice(words[:5]) for _ in range(30_000))]
    out = []
    for i, text in enumerate(texts):
        source = None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}"
        out.append((i * 3, text, None if i % 4 == 0 else "en", source, None if i % 5 == 0 else i))
    out += [out[20], out[20], (60, "another text", "en", "hot", 1), (None, "no id", None, None, 3), (None, None, None, None, None)]
    out += [(1000 + i, f"Row {i} of MANY", "en", "hot", i) for i in range(700)]
    rng.shuffle(out)
    return [(*r, "l", "t", "o", "p", 9) for r in out]  # further columns with names used inside


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def key(row):
    return tuple((x is not None, x) for x in row)


# --- fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, rows, monkeypatch):
    found = fill_in_middle.rearrange(docs).collect()
    assert sorted([tuple(r[:6]) for r in found], key=key) == sorted([brute_fim(r[0], r[1]) for r in rows], key=key)
    assert sorted(r.restored for r in found) == sorted(r[1] or "" for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.rearrange(docs.limit(0)).collect() == []
    none = fill_in_middle.rearrange(docs, fim_percent=0).collect()
    assert {r.form for r in none} == {"plain"} and all(r.output == r.restored for r in none)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_skip_list_reaches_every_rank(fan, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "PIECE", 7)  # lines and characters cross pieces
    for text in ["", "\n", "x", "ä\n日本\n\nend", "".join("é" * (i % 4) + "\n" for i in range(100)), "a" * 50]:
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        points, sizes = fill_in_middle.line_widths(text.encode())
        lanes = fill_in_middle.SkipList(points, sizes, fan)
        assert len(lanes.lanes[-1][0]) <= fan
        for rank in range(len(units) + 1):
            head = "".join(units[:rank])
            assert lanes.place(rank) == (len(head), len(head.encode()))


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restore_with_markers_half_made_by_the_text(form):
    text = "<P\n<S\n>M>\n<\n<M"
    for h1 in range(6):
        for h2 in range(6):
            draw = fill_in_middle.Draw(h1, h2, 0, 0 if form == "spm" else 99)
            made = fill_in_middle.transform(text.encode(), draw, 100, 50)
            assert made[1] == form and fill_in_middle.restore(made[4], form) == text.encode()


# --- token ids


def test_coder_round_trip():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, top, n).astype(np.uint32) for top, n in ((2, 1024), (50_000, 1024), (1 << 32, 300), (7, 1), (9, 0), (1000, 1023))]
    blocks += [np.arange(1024, dtype=np.uint32) * 255, np.full(1024, (1 << 32) - 1, np.uint32), np.tile(np.arange(5, dtype=np.uint32), 200)]
    coded = mixing_coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(mixing_coder.decode_blocks(coded), blocks))
    for one, block in zip(coded, blocks):  # alone or in any company, the same bytes
        assert mixing_coder.encode_blocks([block]) == [one]
        assert (mixing_coder.decode_blocks([one])[0] == block).all()
    with pytest.raises(ValueError):
        mixing_coder.encode_blocks([np.zeros(1025, np.uint32)])


def test_coder_learns_and_notices_damage():
    again = mixing_coder.encode_blocks([np.tile(np.arange(100, 116, dtype=np.uint32), 64)])[0]
    assert len(again) < 2 * 1024 / 4  # sixteen ids in a circle: orders 1 and 2 foresee nearly all
    for at in (0, 5, 20, len(again) // 2, len(again) - 1):
        damaged = bytearray(again)
        damaged[at] ^= 4
        with pytest.raises(mixing_coder.BrokenBlock):
            mixing_coder.decode_blocks([bytes(damaged)])
    with pytest.raises(mixing_coder.BrokenBlock):
        mixing_coder.decode_blocks([again[:-2]])


def test_expectations_sorted_out_equal_those_followed_step_by_step():
    rng = np.random.default_rng(4)
    slots = np.minimum(rng.zipf(1.3, (7, 300)), 1023).astype(np.int16)
    slots[0], slots[1] = 0, np.arange(300) % 3
    past, before = mixing_coder._Past(7), 0
    expected = mixing_coder._expected(slots)
    for t in range(300):
        assert (expected[:, :, t] == past.found(7)).all()
        slot = slots[:, t].astype(np.int64)
        past.teach(slot, mixing_coder._two(slot, before))
        before = slot


def test_alphabets_of_many_blocks_at_once():
    steps = [[0], [255, 254, 65535], [], [65534, 65536, 1], [1 << 31, 7], [], [254, 255, 256]]
    known = [np.cumsum(s, dtype=np.int64) for s in steps]
    sizes = np.array([len(s) for s in steps])
    coded = mixing_coder._pack_alphabets(np.concatenate(known), np.cumsum(sizes))
    head = bytes(mixing_coder._BEGIN)
    found, ends = mixing_coder._unpack_alphabets([head + c + b"rest" for c in coded], sizes)
    assert found.tolist() == np.concatenate(known).tolist()
    assert ends == [len(head) + len(c) for c in coded]


def test_blocks_without_ids_among_others():
    blocks = [np.empty(0, np.uint32)] * 300 + [np.arange(3, dtype=np.uint32)] * 200
    for some in (blocks, blocks[:300]):
        found = mixing_coder.decode_blocks(mixing_coder.encode_blocks(some))
        assert [b.tolist() for b in found] == [b.tolist() for b in some]


def test_more_slots_than_the_alphabet_has_ids():
    block = mixing_coder.encode_blocks([np.array([5, 5, 5, 9], np.uint32)])[0]
    at = mixing_coder._BEGIN + 2  # after two steps of the alphabet
    assert block[at] == 0b10010000
    rest, head = bytearray(block[mixing_coder._BEGIN :]), block[: mixing_coder._HEAD_SIZE]
    rest[2] = 0b11110000
    forged = head + zlib.crc32(rest, zlib.crc32(head)).to_bytes(4, "little") + rest
    with pytest.raises(mixing_coder.BrokenBlock):
        mixing_coder.decode_blocks([forged])


@pytest.mark.parametrize("sizes", [[], [0], [3], [7], [25], [1] * 40, [30, 0, 4], [12, 19, 2]])
def test_blocks_are_gathered(sizes):
    import pyarrow as pa

    rows = iter(range(sum(sizes)))
    batches = [pa.RecordBatch.from_pydict({"x": pa.array([next(rows) for _ in range(n)], pa.int64())}) for n in sizes]
    found = list(token_output._gathered(iter(batches), 10))
    assert [x for b in found for x in b.column("x").to_pylist()] == list(range(sum(sizes)))
    assert all(b.num_rows <= 15 for b in found) and all(b.num_rows >= min(7, sum(sizes)) for b in found)


def test_joined_crc():
    data = bytes(random.Random(1).randbytes(5000))
    parts = [data[:1], data[1:1], data[1:4096], data[4096:]]
    assert token_output.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_joined_crcs_of_many_wholes_at_once():
    wholes = [[b"abc"], [b"", b"x" * 4096, b"yz"], [b"1", b"2", b"3" * 70_000]]
    parts = [p for w in wholes for p in w]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    found = token_output.joined_crcs(crcs, sizes, np.array([0, 1, 4]))
    assert found.tolist() == [zlib.crc32(b"".join(w)) for w in wholes]


def test_tokens_equal_the_whole_texts(rows):
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    whole = Tokenizer.from_file(path)
    tokens = token_output.Tokens(open(path, encoding="utf-8").read())
    assert tokens.cuts
    texts = [r[1] or "" for r in rows]
    for part in (1 << 20, 50):
        token_output.PART, kept = part, token_output.PART
        try:
            for text, ids in zip(texts, tokens.ids(texts)):
                assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids
        finally:
            token_output.PART = kept


def test_pieces_that_come_again_are_kept(monkeypatch):
    path = token_output.tokenizer_path()
    tokens = token_output.Tokens(open(path, encoding="utf-8").read())
    monkeypatch.setattr(token_output, "KEPT", 40)
    learned = []
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda pieces: (learned.extend(pieces.to_pylist()), learn(pieces)))
    letters = "bcdfghjklmnpqrst"
    for k in range(30):
        text = "often used words " + " ".join(f"{letters[k % 16]}{x}{y}a" for x in letters[k // 16 : k // 16 + 3] for y in "aeio")
        (ids,) = tokens.ids([text])
        assert np.frombuffer(ids, np.uint32).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(tokens.known) == len(tokens.begins) == len(tokens.sizes) == len(tokens.again) <= 40
    assert [learned.count(w) for w in (b"often", b" used", b" words")] == [1, 1, 1] and len(learned) > 300


def expected_ids(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_output.tokenizer_path())
    return {r[1]: np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}


def test_token_output(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "LEAST_RANGES", 3)
    path = str(tmp_path / "ids")
    token_output.write(docs, path, token_output.tokenizer_path())
    ids = expected_ids(rows)
    found = token_output.read_documents(spark, path).collect()
    sums = lambda text: (len(ids[text]), zlib.crc32(ids[text].tobytes()))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], key=key) == sorted([(r[0], *sums(r[1])) for r in rows], key=key)
    ordered, start = sorted(found, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == start
        start += r.n_tokens
    assert [key((r.doc_id,)) for r in ordered] == sorted(key((r.doc_id,)) for r in ordered)
    fragments = token_output.read_fragments(spark, path)
    text = {r[0]: r[1] for r in rows if r[0] not in (None, 60)}
    longest = max(text, key=lambda i: len(ids[text[i]]))
    parts = sorted(fragments.where(F.col("doc_id") == longest).collect(), key=lambda r: r["first"])
    assert len(parts) > 1 and b"".join(p.ids for p in parts) == ids[text[longest]].tobytes()
    shards = spark.read.parquet(path).groupBy("shard").agg(F.max("block").alias("b")).collect()
    assert len(shards) == 3 and max(s.b for s in shards) > 2


def test_token_output_of_an_empty_table(spark, docs, tmp_path):
    token_output.write(docs.limit(0), str(tmp_path / "none"), token_output.tokenizer_path())
    assert token_output.read_documents(spark, str(tmp_path / "none")).collect() == []


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*(field(v) for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each leaf its (left, right) level by level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([h for _, h in sorted((key((r[0],)), leaf(*r[:5])) for r in groups[s])]) for s in order}
    root, above = tree([made[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        ranked = sorted(groups[s], key=lambda r: (key((r[0],)), leaf(*r[:5])))
        for r, path in zip(ranked, made[s][1]):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], lower if tampered else r[1], *r[2:5])
            for left, right in path + up:
                node = sha(left, node, right)
            proof = "".join(a + b for a, b in path + up)
            out.append((r[0], s, leaf(*r[:5]), made[s][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("digits", [1, 2])
def test_merkle(docs, rows, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)  # rounds: 700 leaves of one source are one to three blocks deep
    monkeypatch.setattr(merkle, "LEAST_RANGES", 4)
    found = merkle.manifest(docs).drop("tampered").collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute_manifest(rows), key=key)
    assert {r.verified for r in found} == {True, False}


def test_merkle_of_small_tables(spark, docs, rows):
    assert merkle.manifest(docs.limit(0)).collect() == []
    for count in (1, 2):
        few = spark.createDataFrame(rows[:count], SCHEMA)
        assert sorted(map(tuple, merkle.manifest(few).drop("tampered").collect()), key=key) == sorted(brute_manifest(rows[:count]), key=key)
