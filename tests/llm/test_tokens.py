from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textwarden.llm.packing import Piece, SumOfSquares, pack_documents
from textwarden.llm.sentencepiece import BPE, BYTE, CONTROL, NORMAL, UNKNOWN, USER_DEFINED, CharacterMap, Encoder, Model, encode_documents
from textwarden.llm.tokens import WordTokenizer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("abcXYZ .,.,'!éÉßſİıʼn\n\t ́日本0٣|<>_-▁") + ["'s", "n't", "<|endoftext|>", "</s>", "<0x41>", "  ", "ﬁ", "Σ", "\x1c", "\x85", "　", "😀", "\0"]


def random_texts(n, longest=30):
    rng = random.Random(2)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["a" * 500, "é" * 100, " " * 80]


def test_encoding_equals_the_library():
    library, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(Model(Path(MODEL).read_bytes()))
    for text in random_texts(3000):
        ids, starts, ends = coder.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert coder.model.decode(ids.tolist()) == library.decode(ids.tolist()), text
        source = text.encode()
        # The pieces' spans lie one after the other and hold the whole text.
        assert starts.tolist() == [0, *ends[:-1].tolist()][: len(starts)] and ends[-1] == len(source)
        for piece, a, b in zip((coder.model.outputs[i] for i in ids[:-1]), starts, ends):
            assert piece.lstrip(b" ") == source[a:b].replace("▁".encode(), b" ").lstrip(b" ")


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def compiled(mapping):
    """A double array for a few keys, laid out by trying offsets until all children fit."""
    texts, places = b"", {}
    for key, value in mapping.items():
        places[key] = len(texts)
        texts += value + b"\0"
    units, used = {0: 0}, {0}

    def lay(node, prefix):
        children = sorted({k[len(prefix)] for k in mapping if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in mapping
        offset = next(o for o in range(1, 1 << 20) if all((node ^ o ^ c) not in used for c in children + [0] * leaf))
        units[node] |= offset << 10 | leaf << 8
        at = {c: node ^ offset ^ c for c in children}
        used.update(at.values())
        if leaf:
            used.add(node ^ offset)
            units[node ^ offset] = places[prefix] | 1 << 31
        for c, where in at.items():
            units[where] = c
            lay(where, prefix + bytes([c]))

    lay(0, b"")
    blob = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(max(units) + 1))
    return struct.pack("<I", len(blob)) + blob + texts


def small_model(mapping, pieces, remove_extra=1):
    listed = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), *pieces]
    content = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in listed)
    content += field(2, field(3, BPE))
    return Model(content + field(3, field(2, compiled(mapping)) + field(3, 1) + field(4, remove_extra) + field(5, 1)))


def test_longest_prefix_of_the_compiled_map():
    mapping = {b"a": b"1", b"ab": b"22", "é".encode(): b"e", b"abcd": b"", "　".encode(): b" "}
    found = CharacterMap(compiled(mapping))
    assert found.longest(b"abc", 0) == (2, b"22") and found.longest(b"xabcd", 1) == (4, b"")
    assert found.longest(b"ac", 0) == (1, b"1") and found.longest(b"z", 0) is None and found.longest(b"", 0) is None
    assert found.longest("é".encode(), 0) == (2, b"e")


def test_alignment_through_the_map():
    mapping = {"ﬁ".encode(): b"fi", "é".encode(): b"e", "　".encode(): b" ", b"\t": b" "}
    letters = [(c, -10.0 - i, NORMAL) for i, c in enumerate("▁abefix")]
    model = small_model(mapping, [*letters, ("fi", -1.0, NORMAL), ("▁e", -2.0, NORMAL), ("[x y]", 0.0, USER_DEFINED)])
    text = " \t ﬁé　 b[x y]a  "
    normalised, align = model.normalise(text)
    assert normalised == "▁fie▁b[x▁y]a"
    coder, source = Encoder(model), text.encode()
    ids, starts, ends = coder.encode(text)
    spans = {model.pieces[i]: source[a:b].decode() for i, a, b in zip(ids, starts, ends)}
    assert spans["fi"] == "ﬁ" and spans["e"] == "é" and spans["b"] == "b" and spans["a"] == "a"
    assert len(align) == len(normalised.encode()) + 1 and (np.diff(align) >= 0).all()
    assert model.normalise(" \t ")[0] == "" and coder.encode("")[0].tolist() == [2]
    kept = small_model(mapping, letters, remove_extra=0)
    assert kept.normalise(" a")[0] == "▁▁a"


def test_encoding_of_awkward_rows(awkward, empty):
    content = Path(MODEL).read_bytes()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = awkward.collect()
    found = encode_documents(awkward, content).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_eos=True)) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in found) == want
    assert all(r.decoded == library.decode(list(r.ids)) and len(r.ids) == len(r.starts) == len(r.ends) for r in found)
    assert encode_documents(empty, content).count() == 0


def test_words_equal_whole_texts():
    definition = Path(WORDS).read_text(encoding="utf-8")
    library, coder = Tokenizer.from_str(definition), WordTokenizer(definition)
    texts = random_texts(4000)
    for text, got, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, text


def test_sum_of_squares_prefers_to_complete_and_to_spread():
    packer = SumOfSquares(10)
    place = lambda n: list(packer.place(Piece(0, 0, np.arange(n, dtype=np.uint32), n)))
    assert place(6) == [] and packer.counts[6] == 1
    # A second six opens no level four more than needed: four completes the first window.
    assert len(place(4)) == 1 and packer.counts.sum() == 0
    place(3)
    place(3)
    assert packer.counts[6] == 1 or packer.counts[3] == 2
    assert sum(w.level for w in packer.finish()) == 6


@pytest.mark.parametrize("most", [1, 4, 256])
def test_packing_loses_nothing(most):
    rng = random.Random(most)
    lengths = [rng.choice([1, 5, 63, 64, 65, 200, rng.randint(1, 300)]) for _ in range(500)]
    packer, windows = SumOfSquares(64, most), []
    for i, n in enumerate(lengths):
        windows += packer.place(Piece(i, 0, np.arange(n, dtype=np.uint32), n))
        assert packer.open <= most
    windows += packer.finish()
    pieces = defaultdict(list)
    for w in windows:
        assert w.level == sum(len(p.ids) for p in w.pieces) and (w.level == 64 or w.level & (w.level - 1) == 0)
        for p in w.pieces:
            pieces[p.doc_id].append((p.start, p.ids.tolist()))
    for i, n in enumerate(lengths):
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == list(range(n))


def test_packing_of_awkward_rows(awkward, empty):
    definition = Path(WORDS).read_text(encoding="utf-8")
    library = Tokenizer.from_str(definition)
    rows = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    wanted = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    found = pack_documents(rows, definition).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.doc_tokens == len(wanted[r.doc_id])
        parts[r.doc_id].append((r.start, list(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == wanted
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in pack_documents(awkward, definition).collect()) > sum(map(len, wanted.values()))
    assert pack_documents(empty, definition).count() == 0
