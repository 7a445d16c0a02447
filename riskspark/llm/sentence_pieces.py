"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation follows the model's own compiled character map by longest prefix and records, for each
normalised byte, the source byte it came from. The normalised text is cut where a run of the space mark
follows another character: no piece of the vocabulary crosses such a place (checked when the model is
loaded; a model for which it is not so is encoded text by text), so units can be encoded once and looked
up. Every piece is projected back through the alignment to a span of bytes of the original text.

Null and empty texts have no pieces. Repeated rows give repeated rows; ids and other columns play no part.
A model that leaves characters without pieces (no byte pieces) raises, as such text has no whole alignment.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from riskspark.llm.blocks import Kept, map_texts

MARK = "▁"
UNITS = 400_000  # units remembered in one task


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes):
    """(number, value) of each field of a serialised message; values are integers or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double array over bytes, then zero-ended strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.cells = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:]
        self.first = {b for b in range(256) if self.cells and self._child(self._base(0), b) is not None}
        lead = bytes(sorted(self.first))
        self.starts = re.compile(b"[" + re.escape(lead) + b"]") if lead else None

    def _base(self, node: int) -> int:
        cell = self.cells[node]
        return node ^ ((cell >> 10) << ((cell & 512) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.cells) and self.cells[node] & (0x80000000 | 255) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at this place and what replaces it."""
        if not self.cells:
            return None
        base, found = self._base(0), None
        for i in range(at, len(data)):
            node = self._child(base, data[i])
            if node is None:
                break
            base = self._base(node)
            if self.cells[node] >> 8 & 1:
                found = (i + 1 - at, self.cells[base] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1]:end]


class Pieces:
    """A SentencePiece model read from its file, its normaliser rebuilt here."""

    def __init__(self, path: str):
        import sentencepiece
        with open(path, "rb") as f:
            proto = f.read()
        spec = {k: v for field, value in message_fields(proto) if field == 3 for k, v in message_fields(value)}
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=plain_normaliser(proto))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        skip = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(len(names))]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else b"" if skip[i] else n.encode() for i, n in enumerate(names)]
        self.cuts = self.escape and self.prefix and not any(MARK in n.lstrip(MARK) for n in names) and self.model.encode("͸") != [self.model.unk_id()]
        self.size, self.names = np.array([len(b) for b in self.bytes]), [str(i) for i in range(len(self.bytes))]
        self.digits = np.array([len(n) for n in self.names])
        self.units = Kept(self._encode_units, UNITS)

    def _encode_units(self, units: list[str]) -> list[str]:
        """ids of each unit, joined by commas; that the pieces give back the units' bytes is verified on the way."""
        joins = [self.cuts and u[:1] != " " and u[-1:] != " " and u != "" for u in units]  # others would run into their neighbours
        order = [i for i, j in enumerate(joins) if j]
        made: list = [None] * len(units)
        for at in range(0, len(order), 200):
            some = [MARK + units[k] for k in order[at:at + 200]]
            text = "".join(some)
            ids, data = self.model.encode(text), text.encode()
            if b"".join([self.bytes[i] for i in ids]) != data:
                raise ValueError("pieces do not give back their text")
            found = np.array(ids)
            cuts = np.searchsorted(np.cumsum(self.size[found]), np.cumsum([len(u.encode()) for u in some])) + 1
            shown, places = ",".join([self.names[i] for i in ids]), np.cumsum(self.digits[found] + 1)[cuts - 1].tolist()
            for k, begin, end in zip(order[at:at + 200], [0, *places], places):
                made[k] = shown[begin:end - 1]
        for k, j in enumerate(joins):
            if not j:
                unit = MARK + units[k].replace(" ", MARK) if self.cuts else units[k]
                made[k] = ",".join(map(str, self.model.encode(unit)))
        return made

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The character map applied by longest prefix, with the source byte of each byte and of the end."""
        if self.map.starts is None:
            return data, np.arange(len(data) + 1)
        out, align, at = bytearray(), [], 0
        while at < len(data):
            m = self.map.starts.search(data, at)
            stop = m.start() if m else len(data)
            while stop < len(data) and data[stop] & 192 == 128:  # never inside a character
                m = self.map.starts.search(data, stop + 1)
                stop = m.start() if m else len(data)
            out += data[at:stop]
            align.append(np.arange(at, stop))
            at = stop
            if at < len(data):
                hit = self.map.longest(data, at)
                n = hit[0] if hit else 1 + sum(1 for b in data[at + 1:at + 4] if b & 192 == 128) if data[at] >= 192 else 1
                new = hit[1] if hit else data[at:at + n]
                out += new
                align.append(np.full(len(new), at) if hit else np.arange(at, at + n))
                at += n
        return bytes(out), np.concatenate([*align, [len(data)]]).astype(np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, the source byte where it begins."""
        out, align = self._mapped(text.encode())
        if self.squeeze:  # no spaces at the ends, one in a row inside
            cells = np.frombuffer(out, np.uint8)
            solid = cells != 32
            keep = np.flatnonzero(solid | np.concatenate([[False], solid[:-1]])) if len(cells) else np.zeros(0, int)
            if len(keep) and not solid[keep[-1]]:
                keep = keep[:-1]
            end = align[keep[-1] + 1] if len(keep) else 0
            out, align = cells[keep].tobytes(), np.append(align[keep], end)
        if self.prefix and out:
            out, align = b" " + out, np.concatenate([align[:1], align])
        if self.escape:
            wide = np.where(np.frombuffer(out + b"x", np.uint8) == 32, 3, 1)  # the end is one place
            out, align = out.replace(b" ", MARK.encode()), np.repeat(align, wide)
        return out, align

    def units_of(self, text: str) -> list[str]:
        """Units of a text, each without the one space mark that stands before it.

        They begin where spaces follow another character; further marks before a unit stand as spaces.
        """
        if not text:
            return []
        if not self.cuts:
            return [self.normalise(text)[0].decode()]
        if self.map.starts is not None or self.squeeze:
            normal = self.normalise(text)[0].decode()
            text = normal[1:].replace(MARK, " ")
            if not normal:
                return []
        elif MARK in text:
            text = text.replace(MARK, " ")
        units = text.split(" ")
        if "" not in units:
            return units
        made, lead = [], ""
        for u in units:
            if u:
                made.append(lead + u)
                lead = ""
            else:
                lead += " "
        return made + [lead[1:]] if lead else made

    def block(self, texts: list[str]) -> list[str]:
        """The ids of each text joined by commas; what is new in the block is encoded at once."""
        units = [self.units_of(t) for t in texts]
        self.units.need(chain.from_iterable(units))
        known = self.units.__getitem__
        return [",".join(map(known, own)) for own in units]

    def projected(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece of the text the first byte and the end byte of its span in the original text.

        A piece made of one byte of a longer character spans that byte; the added first mark spans nothing.
        """
        normal, align = self.normalise(text)
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover their normalised text")
        return align[ends - sizes], align[ends]

    def spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids with the byte span of each in the original text."""
        ids = numbers(self.block([text])[0])
        starts, ends = self.projected(text, ids)
        return ids.tolist(), starts.tolist(), ends.tolist()

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids) gives: pieces joined, marks as spaces, the added one dropped."""
        joined = b"".join([self.bytes[i] for i in ids]).replace(MARK.encode(), b" ")
        return (joined[1:] if self.prefix and joined[:1] == b" " else joined).decode(errors="replace")


def numbers(ids: str) -> np.ndarray:
    """The numbers of a list joined by commas."""
    return np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One model and its cache for all tasks of a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def plain_normaliser(proto: bytes) -> bytes:
    """The same model with a normaliser that changes nothing: for texts normalised already."""
    # Field 3 of the model: name (1) "identity", no added prefix (3), spaces kept (4) and not escaped (5).
    spec = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
    kept, at = bytearray(), 0
    while at < len(proto):
        begin = at
        key, at = _varint(proto, at)
        if key & 7 == 0:
            _, at = _varint(proto, at)
        else:
            size, at = _varint(proto, at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            at += size
        if key >> 3 != 3:
            kept += proto[begin:at]
    return bytes(kept) + b"\x1a" + bytes([len(spec)]) + spec


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id with ids and the byte span of each piece in the original text."""
    def setup():
        pieces = loaded(model)

        def run(texts):
            made = [pieces.spans(t) for t in texts]
            return {"ids": [m[0] for m in made], "starts": [m[1] for m in made], "ends": [m[2] for m in made]}
        return run

    return map_texts(docs, setup, "ids array<int>, starts array<long>, ends array<long>")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Counts and digests of encoding and decoding, without carrying the ids.

    spans_sha256 digests the starts and then the ends of all pieces in the original bytes, little-endian 64-bit each;
    span_bytes counts the bytes that the pieces cover. The decoded text is made from the ids.
    """
    def setup():
        pieces = loaded(model)

        def run(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "span_bytes": [], "spans_sha256": []}
            for text, shown in zip(texts, pieces.block(texts)):
                ids = numbers(shown)
                starts, ends = pieces.projected(text, ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(pieces.decode(ids.tolist()).encode()).hexdigest())
                out["span_bytes"].append(int((ends - starts).sum()))
                out["spans_sha256"].append(hashlib.sha256(starts.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest())
            return out
        return run

    return map_texts(docs, setup, "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_sha256 string")
