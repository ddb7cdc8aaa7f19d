"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder never runs the merge loop over a text. It takes longest pieces found by Aho-Corasick and keeps a piece only
if it is compatible with the piece before it: merging the two pieces' characters alone must give these two pieces again.
A sequence whose adjacent pieces are all compatible is the merge result. When no compatible piece is left at a place,
it marks the place in a bitfield, drops the last piece and tries that piece's next shorter match.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.texts import with_columns

SPACE = "▁"
#: A text that common normalisers change.
PROBE = " \uff21 \ufb01  x\u0301\u00a0\t\u212b "
NONE = float("-inf")
#: Entries that each of a worker's caches holds at most; they only save time.
CACHE, PAIRS = 170_000, 160_000


class Pieces:
    """A SentencePiece BPE model with identity normalisation, a dummy prefix and byte fallback; others are refused."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[int, str] = {}
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_of: dict[int, int] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.byte_id[self.byte_of[i]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i], self.id[p], self.score[p] = p, i, model.get_score(i)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them")
        self.unknown = {i for i in range(model.get_piece_size()) if model.is_unknown(i)}
        self.unknown_text = model.decode([min(self.unknown)]) if self.unknown else ""
        # The pieces' bytes one after another.
        shown = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text.get(i, "").replace(SPACE, " ").encode() for i in range(model.get_piece_size())]
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.length = np.array([len(b) for b in shown], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.is_byte = np.array([i in self.byte_of for i in range(len(shown))])
        self.is_unknown = np.array([i in self.unknown for i in range(len(shown))])
        # Matches that end at a place of the reversed text start there in the text.
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p[::-1], p)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._young: dict[str, tuple[str, bytes]] = {}
        self._old: dict[str, tuple[str, bytes]] = {}
        self.spans = self._splitter()

    def _splitter(self) -> re.Pattern:
        """Matches the spans of a text that merges can't cross, as no piece has what meets at their borders.

        Characters that are in no longer piece stand alone. If the pieces allow it (this is checked), the others run up
        to a space mark behind another character, and up to a change between letters and other characters.
        """
        long = [p for p in self.id if len(p) > 1]
        joined = sorted({c for p in long for c in p} - {SPACE})
        every = "".join(map(re.escape, joined))
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return re.compile(f"[{every}{SPACE}]+|[^{every}{SPACE}]")
        if any(len({c.isalpha() for c in p.lstrip(SPACE)}) > 1 for p in long):
            return re.compile(f"{SPACE}*[{every}]+|{SPACE}+|[^{every}{SPACE}]")
        letters = "".join(re.escape(c) for c in joined if c.isalpha())
        others = "".join(re.escape(c) for c in joined if not c.isalpha())
        return re.compile(f"{SPACE}*(?:[{letters}]+|[{others}]+)|{SPACE}+|[^{every}{SPACE}]")

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE: join the adjacent symbols that make the piece of the best score, the leftmost of equals, until none do."""
        symbols, score = list(symbols), self.score.get
        gain = [score(x + y, NONE) for x, y in zip(symbols, symbols[1:])]
        while gain and (best := max(gain)) != NONE:
            i = gain.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score(symbols[i - 1] + symbols[i], NONE)
            if i < len(gain):
                gain[i] = score(symbols[i] + symbols[i + 1], NONE)
        return symbols

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives a and b again; with an empty a, whether b's give b."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged([*a, *b]) == [x for x in (a, b) if x]
        return known

    def backtrack(self, span: str) -> list[str]:
        """The pieces of `span`; characters without a piece stand for themselves."""
        n = len(span)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, p in self.automaton.iter(span[::-1]):  # the longest match of a place comes first
            at[n - 1 - end].append(p)
        for i, c in enumerate(span):  # a character without a piece is its own match
            if c not in self.id:
                at[i].append(c)
        failed = bytearray(n // 8 + 1)  # bit i: no compatible way goes on from place i
        out: list[str] = []
        tried: list[int] = [0]
        pos = 0
        while pos < n:
            options, k = at[pos], tried[-1]
            while k < len(options):
                p = options[k]
                k += 1
                end = pos + len(p)
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(out[-1] if out else "", p):
                    break
            else:
                if not out:
                    raise ValueError("no encoding found")
                failed[pos >> 3] |= 1 << (pos & 7)
                tried.pop()
                pos -= len(out.pop())
                continue
            tried[-1] = k
            tried.append(0)
            out.append(p)
            pos += len(p)
        return out

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def decode_raw(self, ids: list[int]) -> str:
        """Pieces joined; runs of bytes read as UTF-8, each byte that fits no character as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.text:
                out.append(self.text[i].replace(SPACE, " "))
            elif i in self.unknown:
                out.append(self.unknown_text)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`, without the space that the encoder puts first."""
        first = next((i for i in ids if i in self.text or i in self.byte_of or i in self.unknown), None)
        text = self.decode_raw(ids)
        return text[1:] if first in self.text and self.text[first].startswith(SPACE) else text

    def decode_utf8(self, ids: np.ndarray) -> bytes:
        """The text of an array of ids in UTF-8; see decode()."""
        if not len(ids):
            return b""
        n = self.length[ids]
        upto = np.cumsum(n)
        out = self.flat[np.repeat(self.start[ids] - upto + n, n) + np.arange(upto[-1])].tobytes()
        if self.is_byte[ids].any() or self.is_unknown[ids].any():
            try:  # pieces are whole characters, so bytes between them are characters if all is UTF-8
                out.decode()
            except UnicodeDecodeError:
                return self.decode(ids.tolist()).encode()
            if self.is_unknown[ids].any() or self.is_byte[ids[0]]:
                return self.decode(ids.tolist()).encode()
        return out[1:] if out.startswith(b" ") else out

    def span(self, span: str) -> tuple[str, bytes]:
        """A span's ids as ',1,2' and as numbers of four bytes, from a cache of two generations."""
        found = self._young.get(span)
        if found is None:
            found = self._old.get(span)
            if found is None:
                ids = [i for p in self.backtrack(span) for i in self.ids_of(p)]
                found = "".join(f",{i}" for i in ids), np.array(ids, np.int32).tobytes()
            if len(self._young) >= CACHE:
                self._old, self._young = self._young, {}
            self._young[span] = found
        return found

    def encode_joined(self, text: str) -> tuple[str, np.ndarray]:
        """All ids, joined by commas and as an array."""
        if not text:
            return "", np.empty(0, np.int32)
        known = self._young.get
        spans = [known(s) or self.span(s) for s in self.spans.findall(SPACE + text.replace(" ", SPACE))]
        return "".join([s[0] for s in spans])[1:], np.frombuffer(b"".join([s[1] for s in spans]), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_joined(text)[1].tolist()


def _utf8(run: bytes) -> str:
    out = []
    while run:
        for n in (1, 2, 3, 4):
            try:
                out.append(run[:n].decode("utf-8"))
                run = run[n:]
                break
            except UnicodeDecodeError:
                if n >= min(4, len(run)):
                    out.append("�")
                    run = run[1:]
                    break
    return "".join(out)


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model per Python worker; `path` is a file of an installed package, the same on all machines."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", ids: bool = True, digests: bool = False, keep_text: bool = True
) -> DataFrame:
    """`docs` with `n_tokens`, and with `ids` (array) or with `ids_sha256, decoded_sha256` if asked for.

    Null texts count as empty and have no ids. Texts of any length are encoded whole, each row on its own, so rows may
    repeat and an empty table gives an empty result. Columns of `docs` with the new names are replaced. Without
    `keep_text` the text column goes to Python once and does not come back.
    """
    new = [("n_tokens", "bigint", pa.int64())] + [("ids", "array<int>", pa.list_(pa.int32()))] * ids
    if digests:
        new += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]

    def make():
        model = pieces(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(texts: list[str]) -> list[list]:
            got = [model.encode_joined(t) for t in texts]
            out: list[list] = [[len(i) for _, i in got]]
            if ids:
                out.append([i for _, i in got])
            if digests:
                out += [[sha(j.encode()) for j, _ in got], [sha(model.decode_utf8(i)) for _, i in got]]
            return out

        return work

    return with_columns(docs, F.col(text_col), make, new, None if keep_text else [c for c in docs.columns if c.lower() != text_col.lower()])


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`rows` with the text of `ids_col` in `out_col`; null ids give null, no ids an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = pieces(model_path)
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return rows.withColumn(out_col, text(F.col(ids_col)))
