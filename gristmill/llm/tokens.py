"""Token ids of whole texts by a tokenizer file, with a cache of the pieces between spaces."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DROPS_SPACE, KEEPS_SPACE = "drops", "keeps"
STOPS = frozenset(".,;:!?")
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Encodes text as the tokenizer does, piece by piece.

    Two kinds of tokenizer are supported: those that drop white space and lower the case, and
    mark the last token of a word; and byte-level ones, where a word's first token may begin with
    the space before it. No token spans a single space between two other characters otherwise, so
    a text is cut there and each distinct piece is encoded once while it stays in the cache.
    Where a piece is empty or touches other white space, a byte-level tokenizer gets the whole text.

    The cache has two generations of `generation` pieces at most; a piece found in the old one
    moves to the young one, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str, spaces: str, generation: int | None = None, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps, self.longest = spaces == KEEPS_SPACE, longest
        self.generation = generation or (400_000 if self.keeps else 250_000)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        mark = vocabulary and [i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.keeps else t.endswith("</w>"))]
        self.edge[mark] = True
        self.stops = {c: self.raw([c])[0] for c in STOPS}

    def raw(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def whole(self, piece: str) -> bool:
        return not self.keeps or bool(piece) and not piece[0].isspace() and not piece[-1].isspace()

    def alpha(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters only, each one word, encoded in runs and cut at the word marks."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 2048):
            some = pieces[at : at + 2048]
            ids = np.frombuffer(self.raw([" " + " ".join(some)])[0], "<u4")
            marks = np.flatnonzero(self.edge[ids])
            if len(marks) != len(some):
                out += self.raw([" " + p for p in some])
                continue
            cuts = (np.append(marks, len(ids)) if self.keeps else np.append(0, marks + 1)) * 4
            data, cuts = ids.tobytes(), cuts.tolist()
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def known(self, units: list[str], encode) -> list[bytes]:
        """Ids of distinct units, from the cache or by `encode`, which gets a list of those not in it."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, units))
        miss = [i for i, ids in enumerate(out) if ids is None]
        names = [units[i] for i in miss]
        found = list(map(self.old.get, names))
        todo = [u for u, ids in zip(names, found, strict=True) if ids is None]
        fresh = iter(encode(todo))
        found = [next(fresh) if ids is None else ids for ids in found]
        for i, ids in zip(miss, found, strict=True):
            out[i] = ids
        if max(map(len, names), default=0) > self.longest:
            self.young.update((u, ids) for u, ids in zip(names, found, strict=True) if len(u) <= self.longest)
        else:
            self.young.update(zip(names, found, strict=True))
        return out

    def ids_of(self, pieces: pa.Array) -> list[bytes | None]:
        """Ids of distinct pieces that follow a space; None where only the whole text decides.

        A word of letters and a stop after it are two units; equal words are one unit.
        """
        last = pc.utf8_slice_codeunits(pieces, -1)
        stopped = pc.and_(pc.is_in(last, value_set=pa.array(sorted(STOPS), pieces.type)), pc.greater(pc.utf8_length(pieces), 1))
        stem = pc.if_else(stopped, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        simple = pc.utf8_is_alpha(stem)
        if not self.keeps:
            odd = pc.match_substring(stem, "İ")  # the one letter whose lower case is not letters alone
            wide = pc.and_(simple, pc.invert(pc.string_is_ascii(stem)))
            if not unicodedata.is_normalized("NFC", " ".join(stem.filter(wide).to_pylist())):
                odd = pc.or_(odd, pa.array([not unicodedata.is_normalized("NFC", x) for x in stem.to_pylist()]))
            simple = pc.and_not(simple, odd)
        at, coded = np.flatnonzero(simple.to_numpy(zero_copy_only=False)), stem.filter(simple).dictionary_encode()
        words = self.known(coded.dictionary.to_pylist(), self.alpha)
        out: list[bytes | None] = [None] * len(pieces)
        for i, w in zip(at.tolist(), coded.indices.to_pylist(), strict=True):
            out[i] = words[w]
        with_stop = np.flatnonzero(pc.and_(simple, stopped).to_numpy(zero_copy_only=False))
        for i, c in zip(with_stop.tolist(), last.take(pa.array(with_stop)).to_pylist(), strict=True):
            out[i] += self.stops[c]
        rest = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        names = pieces.take(pa.array(rest)).to_pylist()
        good = [(i, p) for i, p in zip(rest.tolist(), names, strict=True) if self.whole(p)]
        for (i, _), ids in zip(good, self.known([p for _, p in good], self.spaced), strict=True):
            out[i] = ids
        return out

    def spaced(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 4096):
            out += self.raw([" " + p for p in pieces[at : at + 4096]])
        return out

    def trim(self) -> None:
        """Drop the old generation, for what the worker does next."""
        self.old = {}

    def encode(self, col: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a column; a null is empty."""
        whole = pc.fill_null(col.cast(pa.large_string()), "")
        if not self.keeps:  # neither case nor the kind of white space matters
            whole = pc.ascii_lower(pc.replace_substring(whole, pattern="\n", replacement=" "))
        lists = pc.split_pattern(whole, pattern=" ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids = self.ids_of(pieces)
        unknown = np.fromiter((x is None for x in ids), bool, len(ids))
        n, first, ids = len(col), len(ids), [x or b"" for x in ids]
        if self.keeps:  # no space before the first piece
            leads = pieces.take(pa.array(index[at[:-1]])).to_pylist()
            ids += self.raw(leads)
            touch = np.fromiter((bool(p) and p[-1].isspace() for p in leads), bool, n)
            index[at[:-1]] = np.arange(first, first + n)
            unknown = np.concatenate([unknown, touch])
        if unknown.any():
            count = np.concatenate([[0], np.cumsum(unknown[index])])
            mixed = np.flatnonzero(count[at[1:]] > count[at[:-1]])
            blank = len(ids)
            ids.append(b"")
            for i, whole in zip(mixed.tolist(), self.raw([col[i].as_py() or "" for i in mixed.tolist()]), strict=True):
                index[at[i] : at[i + 1]] = blank
                index[at[i]] = len(ids)
                ids.append(whole)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        length = size[index]
        ends = np.cumsum(length)
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
        spread = np.repeat((begin[index] - (ends - length)).astype(kind), length)
        spread += np.arange(len(spread), dtype=kind)
        data, bounds = flat[spread].tobytes(), (np.concatenate([[0], ends])[at] * 4).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoder(path: str, spaces: str, generation: int | None = None) -> Encoder:
    """The encoder of this Python worker; its cache serves later tasks too."""
    key = (path, spaces, generation)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, spaces, generation)
    return _encoders[key]
