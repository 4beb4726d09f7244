"""SentencePiece BPE encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at every position the longest prefix in the map (or, before
that, the longest user-defined symbol) is replaced, and each normalised byte remembers the source byte it came from.
The normalised text is segmented by byte-pair merges, best score first, leftmost among equals; pieces outside the
vocabulary fall back to bytes. Through the recorded alignment every piece has a byte span of the original text.

No piece of the usual vocabularies has a word mark behind another character, so no merge crosses from one word into the
next mark. The text is then segmented word by word, and a worker remembers the words it has seen, up to a bound; the
result is that of the whole text. Other vocabularies are segmented whole.

Null texts count as empty; an empty text has the end id alone. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm.columns import narrowed
from textwarden.llm.worker_memory import remembered

MARK = "▁"
# Kinds of pieces and fields of a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
# A worker forgets its words when it holds so many.
WORDS = 800_000
ROWS_OUT = 256
# Up to so many characters a word is merged without a priority queue.
SHORT = 64
NO_MERGE = float("-inf")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = array("I", compiled[4 : 4 + size])
        self.replacements = compiled[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix in the map at this byte."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = _offset(unit)
        for length, byte in enumerate(source[at:], 1):
            node ^= byte
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = length, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Model:
    def __init__(self, content: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.outputs: list[bytes] = []
        self.is_byte: list[bool] = []
        self.unknown = 0
        self.user_defined: list[str] = []
        compiled, self.dummy_prefix, self.remove_extra, self.escape, kind = b"", True, True, True, 1
        for number, value in _fields(content):
            if number == 1:
                self._add_piece(dict(_fields(value)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                compiled = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                self.escape = bool(spec.get(5, 1))
        if kind != BPE:
            raise ValueError("only BPE models are supported")
        self.map = CharacterMap(compiled)
        self.user_pattern = (
            re.compile("|".join(map(re.escape, sorted(self.user_defined, key=len, reverse=True))))
            if self.user_defined
            else None
        )
        self.merge_scores = {piece: score for piece, (score, _) in self.scores.items()}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.scores)
        self.end_id = self.pieces.index("</s>")

    def _add_piece(self, fields: dict) -> None:
        piece, kind, n = fields[1].decode(), fields.get(3, NORMAL), len(self.pieces)
        self.pieces.append(piece)
        self.is_byte.append(kind == BYTE)
        self.outputs.append(piece.replace(MARK, " ").encode())
        if kind in (NORMAL, USER_DEFINED):
            # A user-defined symbol is a symbol from the start and takes part in no merge of its characters.
            self.scores[piece] = struct.unpack("<f", fields.get(2, b"\0\0\0\0"))[0], n
            if kind == USER_DEFINED:
                self.user_defined.append(piece)
        elif kind == BYTE:
            self.byte_ids[int(piece[3:5], 16)] = n
            self.outputs[n] = bytes([int(piece[3:5], 16)])
        elif kind == UNKNOWN:
            self.unknown, self.outputs[n] = n, " ⁇ ".encode()
        elif kind == CONTROL:
            self.outputs[n] = b""
        else:
            raise ValueError("models with unused pieces are not supported")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        if not text:
            return "", np.zeros(1, np.int32)
        if not self.map.units and not self.remove_extra and self.escape and self.user_pattern is None:
            # Nothing in the map: only blanks change, from one byte to the three of the mark.
            source = np.frombuffer(text.encode(), np.uint8)
            align = np.repeat(np.arange(len(source), dtype=np.int32), np.where(source == 32, 3, 1))
            head = [0] * 3 * self.dummy_prefix
            marked = MARK * self.dummy_prefix + text.replace(" ", MARK)
            return marked, np.concatenate([head, align, [len(source)]]).astype(np.int32)
        return self._normalise_mapped(text)

    def _normalise_mapped(self, text: str) -> tuple[str, np.ndarray]:
        source, at = text.encode(), 0
        out, align = bytearray(), []
        blank = MARK.encode() if self.escape else b" "
        end = len(source)

        def step(at: int) -> tuple[int, bytes]:
            head = source[at]
            width = 1 if head < 128 else 2 if head < 224 else 3 if head < 240 else 4
            if self.user_pattern and (m := self.user_pattern.match(source[at:].decode())):
                kept = m[0].encode()
                return len(kept), kept
            return self.map.longest(source, at) or (width, source[at : at + width])

        if self.remove_extra:
            while at < end and step(at)[1] == b" ":
                at += step(at)[0]
            if at == end:
                return "", np.zeros(1, np.int32)
        if self.dummy_prefix:
            out += blank
            align += [at] * len(blank)
        after_blank = self.remove_extra
        while at < end:
            width, replaced = step(at)
            if after_blank and replaced.startswith(b" "):
                replaced = replaced.lstrip(b" ")
            if replaced:
                written = replaced.replace(b" ", blank)
                out += written
                align += [at] * len(written) if replaced != source[at : at + width] or len(written) != width else range(at, at + width)
                after_blank = self.remove_extra and replaced.endswith(b" ")
            at += width
        if self.remove_extra:
            while out.endswith(blank):
                end = align[-len(blank)]
                del out[-len(blank) :], align[-len(blank) :]
        return out.decode(), np.array([*align, end], np.int32)

    def segment(self, word: str) -> tuple[list[int], list[int]]:
        """Ids and byte lengths of the pieces of a normalised text."""
        symbols = list(word)
        if self.user_pattern:
            symbols, last = [], 0
            for m in self.user_pattern.finditer(word):
                symbols += [*word[last : m.start()], m[0]]
                last = m.end()
            symbols += word[last:]
        symbols = self._merged_short(symbols) if len(symbols) <= SHORT and not self.user_pattern else self._merged(symbols)
        scores, ids, widths = self.scores, [], []
        for symbol in symbols:
            raw = symbol.encode()
            if found := scores.get(symbol):
                ids.append(found[1])
                widths.append(len(raw))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in raw]
                widths += [1] * len(raw)
            elif ids and ids[-1] == self.unknown:
                widths[-1] += len(raw)
            else:
                ids.append(self.unknown)
                widths.append(len(raw))
        return ids, widths

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """All merges, with the scores of the pairs in a list: for words the quickest way."""
        score = self.merge_scores.get
        pairs = [score(a + b, NO_MERGE) for a, b in pairwise(symbols)]
        while pairs and (best := max(pairs)) != NO_MERGE:
            i = pairs.index(best)
            symbols[i : i + 2] = [merged := symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(merged + symbols[i + 1], NO_MERGE)
            if i:
                pairs[i - 1] = score(symbols[i - 1] + merged, NO_MERGE)
        return symbols

    def _merged(self, symbols: list[str]) -> list[str]:
        """All merges, with the pairs in a priority queue, so that a word of any length takes n log n steps."""
        n = len(symbols)
        following, previous = [*range(1, n), -1], [*range(-1, n - 1)]
        scores = self.scores
        fixed = set(self.user_defined)
        agenda = []
        for i in range(n - 1):
            if (found := scores.get(symbols[i] + symbols[i + 1])) and not fixed & {symbols[i], symbols[i + 1]}:
                agenda.append((-found[0], i, symbols[i] + symbols[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, merged = heappop(agenda)
            j = following[i]
            # Either part may have gone into another merge meanwhile.
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, ""
            after = following[i] = following[j]
            if after >= 0:
                previous[after] = i
                if (found := scores.get(merged + symbols[after])) and symbols[after] not in fixed:
                    heappush(agenda, (-found[0], i, merged + symbols[after]))
            before = previous[i]
            if before >= 0 and (found := scores.get(symbols[before] + merged)) and symbols[before] not in fixed:
                heappush(agenda, (-found[0], before, symbols[before] + merged))
        return [x for x in symbols if x]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; a blank that the encoder put in front goes."""
        out = self.outputs
        raw = b"".join([out[i] for i in ids])
        if self.dummy_prefix or self.remove_extra:
            first = next((i for i in ids if out[i]), None)
            if first is not None and self.pieces[first].startswith(MARK):
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            # Bytes that form no character stand for one replacement each.
            return raw.decode(errors="surrogateescape").translate(dict.fromkeys(range(0xDC80, 0xDD00), "�"))


class Encoder:
    """A model with the words a worker has met, their pieces laid end to end."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pattern = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if model.by_word else "(?s).+")
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        # Buffers are never empty: one unused place each.
        self.ids, self.widths, self.starts = array("i", [0]), array("i", [0]), array("q", [1])

    def _number(self, word: str) -> int:
        ids, widths = self.model.segment(word)
        self.ids.extend(ids)
        self.widths.extend(widths)
        self.starts.append(len(self.ids))
        # Long words are rare and do not come back.
        at = len(self.starts) - 2
        if len(word) <= 64:
            self.words[word] = at
        return at

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and the source byte spans of the pieces."""
        if len(self.starts) > WORDS:
            self._forget()
        normalised, align = self.model.normalise(text)
        known, number = self.words.get, self._number
        words = self.pattern.findall(normalised)
        places = np.array([number(w) if (i := known(w)) is None else i for w in words], np.int64)
        # Views of what the words have so far; indexing copies, so they are gone before the arrays grow again.
        starts = np.frombuffer(self.starts, np.int64)
        first, count = starts[places], starts[places + 1] - starts[places]
        gather = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids, widths = np.frombuffer(self.ids, np.int32), np.frombuffer(self.widths, np.int32)
        ids, widths = (ids[gather], widths[gather]) if len(gather) else (np.empty(0, np.int32),) * 2
        del starts
        ends = np.cumsum(widths)
        last = len(text.encode())
        return (
            np.append(ids, self.model.end_id).astype(np.int32),
            np.append(align[ends - widths], last).astype(np.int32),
            np.append(align[ends], last).astype(np.int32),
        )


def encoder(content: bytes) -> Encoder:
    """The worker's encoder for a model, with the words it has met in earlier tasks."""
    return remembered(("sentencepiece", content), lambda: Encoder(Model(content)))


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids, starts, ends, decoded``.

    ``ids`` ends with the end id; ``starts`` and ``ends`` are the pieces' byte spans in the UTF-8 source; ``decoded``
    is the text that the ids stand for. ``model`` is the content of a model file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                found = [coder.encode(t) for t in batch["text"].to_pylist()]
                offsets = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[k] for x in found])))
                    for k in range(3)
                ]
                decoded = pa.array([coder.model.decode(x[0].tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *lists, decoded], names=["doc_id", "ids", "starts", "ends", "decoded"]
                )

    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return narrowed(docs, id_col, text_col).mapInArrow(run, schema)
