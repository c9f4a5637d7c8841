import random
import struct

import numpy as np
import pytest

from spectrail.llm import piece_codec, queries, token_count

from .conftest import AWKWARD

DIR = "/root/testdata/sf0.001"
ODD = [
    "", "  a  b ", "<|endoftext|>x<|endoftext|>", "a" * 3000, "\x00\x1c   x", "▁a▁▁b", " ", "\n\n x", "日本語テスト 😀😀", "é" * 50, "1234567 890",
    "it's we'll\t\t x", "x \n", "…“q”", "ÀÉ 　z", "￾�", "<s> </s> <0x41> <unk>",
]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab ▁\n\t1é日😀.,<>s/'") for _ in range(rng.randint(1, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def piece():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.vocabulary("piece_bpe_32k.model")
    return piece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(piece):
    own, lib = piece
    for text in texts():
        ids, begins, ends = own.encode(text)
        assert ids.tolist() == lib.encode(text)
        assert own.decode(ids) == lib.decode(ids.tolist())
        proto = lib.encode(text, return_type="proto")
        at = 0
        for i, (p, b, e) in enumerate(zip(proto.pieces, begins.tolist(), ends.tolist())):
            assert b == p.begin and (e == p.end or not p.surface)  # bytes of a character share its span
            assert p.surface in ("", text.encode()[b:e].decode()) and b >= at
            at = b


def test_plain_way_equals_the_character_map(piece):
    """The model's map is empty: longest-prefix normalisation gives what the short way for such a map gives."""
    own = piece[0]
    assert not own.map.units
    for text in texts():
        if text:
            normal, at = own.normalise(text)
            assert normal == "▁" + text.replace(" ", "▁") and at.tolist() == own._plain_starts(text).tolist()


def test_kept_tables_are_bounded(piece):
    own, counter = piece_codec.Codec(queries.vocabulary("piece_bpe_32k.model"), most=1000), token_count.Counter(queries.vocabulary("byte_bpe_50k.json"), most=1000)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("日本語学校会社人間大小") for _ in range(rng.randint(1, 200)))
        assert own.encode(text)[0].tolist() == piece[1].encode(text)
        counter.count(text)
        for table, module in ((own, piece_codec), (counter, token_count)):
            assert len(table) <= 1000 and table.held <= module.ENTRY * 1000 and all(len(k) <= module.LONG for k in table)


@pytest.mark.parametrize("change", [{"ignore_merges": True}, {"dropout": 0.1}, {"continuing_subword_prefix": "##"}, {"end_of_word_suffix": "</w>"}, {"use_regex": False}])
def test_other_vocabularies_are_refused(tmp_path, change):
    import json

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer" if "use_regex" in change else "model"] |= change
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="supported"):
        token_count.Counter(f"{tmp_path}/v.json")


def test_scan_and_heap_merge_alike(piece, monkeypatch):
    own = piece[0]
    words = [t for t in texts() if t]
    short = [own.merge(t) for t in words]
    monkeypatch.setattr(piece_codec, "SHORT", 0)
    assert [own.merge(t) for t in words] == short


def test_decoding_any_ids(piece):
    own, lib = piece
    rng = random.Random(2)
    for n in range(300):
        ids = [rng.randrange(3, 259) if n % 3 else rng.randrange(32000) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, np.int32)) == lib.decode(ids)


def compiled_map(rules):
    """A double-array trie over the keys' bytes with strings, in the compiled form, by plain first fit."""
    children = {b"": {}}
    for key in rules:
        for i in range(len(key)):
            children.setdefault(key[:i], {})[key[i]] = key[: i + 1]
            children.setdefault(key[: i + 1], {})
    strings, where = b"", {}
    for key, value in rules.items():
        where[key] = len(strings)
        strings += value + b"\0"
    units, place = {0: 0}, {b"": 0}
    queue = [b""]
    while queue:
        node = queue.pop(0)
        labels = sorted(children[node]) + ([0] if node in rules else [])
        offset = next(o for o in range(1, 5000) if all(((place[node] ^ o) ^ c) not in units for c in labels))
        units[place[node]] |= (offset << 10) | ((1 << 8) if node in rules else 0)
        for c in labels:
            at = place[node] ^ offset ^ c
            units[at] = c
            if c or node not in rules:
                place[children[node][c]] = at
                queue.append(children[node][c])
            else:
                units[at] = (1 << 31) | where[node]
    size = max(units) + 1
    array = [units.get(i, 0) for i in range(size)]
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *array) + strings


def test_longest_prefixes_and_alignment(piece):
    rules = {"ﬁ".encode(): b"fi", b"ab": b"x", b"abc": b"yz", "　".encode(): b" ", b"q": b""}
    cmap = piece_codec.CharacterMap(compiled_map(rules))
    assert cmap.longest(b"abcd", 0) == (3, b"yz") and cmap.longest(b"abd", 0) == (2, b"x") and cmap.longest(b"zz", 0) == (0, b"")
    own = piece_codec.Codec(queries.vocabulary("piece_bpe_32k.model"))
    own.map = cmap
    text = "abcﬁ　qabé"
    normal, at = own.normalise(text)
    assert normal == "▁yzfi▁xé" and at.tolist() == [0, 0, 0, 3, 3, 6, 10, 12, 14]
    ids, begins, ends = own.encode(text)
    pieces = [own.pieces[i] for i in ids]
    assert "".join(pieces) == normal
    done = 0
    for p, b, e in zip(pieces, begins.tolist(), ends.tolist()):
        assert b == at[done] and e == at[done + len(p)]
        done += len(p)
    own.squeeze = True
    assert own.normalise("  ab   c ")[0] == "▁x▁c"


def test_encode_table(spark, docs_of, piece):
    lib, rows = piece[1], piece_codec.encode(docs_of(AWKWARD), queries.vocabulary("piece_bpe_32k.model"), batch_pieces=50, cached=100).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in rows) == sorted((str(i), tuple(ids := lib.encode(t or "")), lib.decode(ids)) for i, t in AWKWARD)
    assert piece_codec.encode(docs_of(AWKWARD).limit(0), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_op4_query(spark, piece):
    import hashlib

    lib, text = piece[1], {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = queries.op4_piece_offsets(spark, DIR).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = lib.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        spans = [(p.begin, p.end) for p in lib.encode(text[r.doc_id], return_type="proto").pieces if p.surface]
        own = list(zip(r.begins, r.ends, strict=True))
        assert len(own) == len(ids) and set(spans) <= set(own)


def test_counts_equal_the_library(spark, docs_of):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary("byte_bpe_50k.json")
    own, lib = token_count.Counter(path, most=50), tokenizers.Tokenizer.from_file(path)
    for text in texts():
        assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    rows = token_count.count_tokens(docs_of(AWKWARD), path).collect()
    want = [(str(i), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in AWKWARD]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert token_count.count_tokens(docs_of(AWKWARD).limit(0), path).count() == 0
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) for r in queries.op9_heap_token_counts(spark, DIR).collect())
