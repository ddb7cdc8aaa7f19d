"""Cross-tokenizer alignment: which tokens of two tokenizers lie on the same bytes, and how often the corpus says so.

A text is encoded by a byte-level BPE (A) and by SentencePiece (B), both with a space before it. Byte offsets where
tokens of both end cut the tokens into groups; a link is a pair of tokens, one of each side, in the same group.

Both encoders work on each stretch from a space behind another character up to the next such space by itself: A's
pattern lets white space only begin a token, and no piece of B has a space behind another character (this is checked). So
stretches are encoded and aligned once and their alignments kept, and a text's alignment is that of its stretches.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.pieces import PROBE, SPACE
from voxelith.llm.texts import with_columns
from voxelith.storage import materialise

#: Stretches whose alignments a worker keeps at most in each of two generations; they only save time.
CACHE = 190_000
#: Links of one group beyond which equal tokens of it are expanded together.
GROUP_LINKS = 1 << 16
#: Groups that a pair's rows are dealt to before they are summed.
SALT = 16
#: Pairs of ids that are broadcast at most: the most frequent ones. The others are looked up by a shuffle.
COMMON = 1 << 20
#: What a place between two stretches looks like, and what a text has where stretches aren't simply words.
BETWEEN, ODD = re.compile(r"(?<=[^\s\x85\u180e\u200b\ufeff])(?= )"), re.compile(r"[\s\x85\u180e\u200b\ufeff] ")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in: printable Latin-1 is itself, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """A byte-level BPE file of the tokenizers library (A) and a SentencePiece model (B)."""

    def __init__(self, bpe_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        shown = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocabulary.items()}
        self.a_bytes = [shown.get(i, b"") for i in range(1 + max(shown))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        if self.b.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them")
        self.b_bytes, normal = [], []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                normal.append(p)
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("the model has pieces with a space behind another character")
        if {i for x in self.a_bytes if len(x) == 1 for i in x} != set(range(256)) or sum(map(self.b.is_byte, range(len(self.b_bytes)))) != 256:
            raise ValueError("a vocabulary lacks bytes")
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # An id and what follows it: a comma within a side of a group, a bar between its sides, a semicolon behind it.
        self.base = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = np.array([f"{i}{end}" for end in ",|;" for i in range(self.base)], object)
        self.lone_space = [self.b.piece_to_id(SPACE)]
        self._young: dict[str, tuple | None] = {}
        self._old: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        """`text` with a space before it, cut before each space that is behind another character; without these spaces."""
        if ODD.search(text) or text.startswith(" "):
            return [s[1:] for s in BETWEEN.split(" " + text)]
        return text.split(" ")

    def _encoded(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        b = self.b.encode(stretches, num_threads=1)
        return a, [ids if s else self.lone_space for s, ids in zip(stretches, b)]

    def _matching(self, stretches: list[str], a: list[list[int]], b: list[list[int]]) -> list[int]:
        """The stretches whose tokens' bytes are theirs, on both sides.

        Tokens stand for their texts in order, and all bytes have tokens, so the bytes can only differ where a character
        that isn't a space is written as one, and then their number differs: lengths tell.
        """
        size = np.array([1 + (len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))) for s in stretches])
        good = np.ones(len(stretches), bool)
        for side, length in ((a, self.a_length), (b, self.b_length)):
            upto = np.concatenate([[0], np.cumsum(length[_flat(side)])])
            ends = np.cumsum(np.array(list(map(len, side))))
            good &= np.diff(np.concatenate([[0], upto[ends]])) == size
        return np.flatnonzero(good).tolist()

    def align(self, stretches: list[str]) -> list[tuple | None]:
        """(numbers of tokens of A and B, groups and links as bytes, the groups as text, a key for each distinct link and how
        often it occurs, both as bytes) each.

        None where the bytes of the tokens aren't the stretch. A key is A's id * 2^32 + B's id.
        """
        if not stretches:
            return []
        found: list[tuple | None] = [None] * len(stretches)
        a, b = self._encoded(stretches)
        good = self._matching(stretches, a, b)
        if not good:
            return found
        if len(good) < len(stretches):
            a, b = [a[k] for k in good], [b[k] for k in good]
        na, nb = np.array(list(map(len, a))), np.array(list(map(len, b)))
        fa, fb = _flat(a), _flat(b)
        # The stretches stand one after another, so ends of stretches are common cuts too.
        a_end, b_end = np.cumsum(self.a_length[fa]), np.cumsum(self.b_length[fb])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        ga, gb = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        a_from, b_from = np.cumsum(ga) - ga, np.cumsum(gb) - gb
        # Links of ordinary groups: each token of A is repeated for the tokens of B in its group.
        ordinary = ga * gb <= GROUP_LINKS
        times = np.where(ordinary, gb, 0)[a_group]
        i = np.repeat(np.arange(len(fa)), times)
        j = b_from[a_group[i]] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        keys, group, many = [fa[i] << 32 | fb[j]], [a_group[i]], [np.ones(len(i), np.int64)]
        for g in np.flatnonzero(~ordinary):  # equal tokens of a very large group are expanded together
            x, nx = np.unique(fa[a_from[g] : a_from[g] + ga[g]], return_counts=True)
            y, ny = np.unique(fb[b_from[g] : b_from[g] + gb[g]], return_counts=True)
            keys.append((x[:, None] << 32 | y).ravel())
            many.append((nx[:, None] * ny).ravel())
            group.append(np.full(len(keys[-1]), g))
        keys, group, many = np.concatenate(keys), np.concatenate(group), np.concatenate(many)
        of_group = np.repeat(np.arange(len(good)), na)[a_from]  # each group's stretch
        own = of_group[group]
        order = np.lexsort((keys, own))
        keys, own, many = keys[order], own[order], many[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])
        keys, own, many = keys[first], own[first], np.add.reduceat(many, first)
        n_groups = np.bincount(of_group, minlength=len(good))
        n_links = np.add.reduceat(ga * gb, np.cumsum(n_groups) - n_groups)
        # All ids as they are shown: those of A, then those of B of each group.
        shown = np.empty(len(fa) + len(fb), np.int64)
        at_a, at_b = np.arange(len(fa)) + b_from[a_group], np.arange(len(fb)) + (a_from + ga)[b_group]
        shown[at_a] = fa + self.base * np.r_[a_group[1:] != a_group[:-1], True]
        shown[at_b] = fb + 2 * self.base * np.r_[b_group[1:] != b_group[:-1], True]
        texts = self.shown[shown].tolist()
        s_from, k_from = (np.r_[0, np.cumsum(c)].tolist() for c in (na + nb, np.bincount(own, minlength=len(good))))
        counts = np.stack([na, nb, n_groups, n_links], 1).astype(np.int64).tobytes()
        keys, many = keys.tobytes(), many.tobytes()
        for k, of in enumerate(good):
            h = slice(8 * k_from[k], 8 * k_from[k + 1])
            found[of] = (counts[32 * k : 32 * k + 32], "".join(texts[s_from[k] : s_from[k + 1]]), keys[h], many[h])
        return found

    def texts(self, texts: list[str]) -> list[list]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256, keys (sorted) and how often each occurs, a value for each text."""
        cut = [self.stretches(t) if t else [] for t in texts]
        if len(self._young) > CACHE:
            self._old, self._young = self._young, {}
        asked = set().union(*cut) - self._young.keys()
        old = asked & self._old.keys()
        self._young.update((s, self._old[s]) for s in old)
        new = list(asked - old)
        self._young.update(zip(new, self.align(new)))
        known = self._young.__getitem__
        out: list[list] = [[] for _ in range(7)]
        for some in cut:
            parts = list(map(known, some))
            if not parts or None in parts:
                row = (0, 0, 0, 0, "", [], [])
            else:
                counts, shown, keys, many = zip(*parts)
                k, n = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(many), np.int64)
                order = np.argsort(k)
                k = k[order]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                total = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 4).sum(0).tolist()
                row = (*total, hashlib.sha256("".join(shown)[:-1].encode()).hexdigest(), k[first], np.add.reduceat(n[order], first))
            for column, value in zip(out, row):
                column.append(value)
        return out


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bpe_path: str, piece_path: str) -> Aligner:
    """One for each Python worker; the files are those of an installed package, the same on all machines."""
    if (bpe_path, piece_path) not in _aligners:
        _aligners[bpe_path, piece_path] = Aligner(bpe_path, piece_path)
    return _aligners[bpe_path, piece_path]


def aligned(docs: DataFrame, bpe_path: str, piece_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` with `n_a, n_b, n_groups, n_links, groups_sha256`, and `keys` and `many`: the distinct links
    (A's id * 2^32 + B's id) of each text and how often it has them. Columns with these names are replaced.
    """
    new = [("n_a", "bigint", pa.int64()), ("n_b", "bigint", pa.int64()), ("n_groups", "bigint", pa.int64()), ("n_links", "bigint", pa.int64())]
    new += [("groups_sha256", "string", pa.string()), ("keys", "array<bigint>", pa.list_(pa.int64())), ("many", "array<bigint>", pa.list_(pa.int64()))]
    return with_columns(docs, F.col(text_col), lambda: aligner(bpe_path, piece_path).texts, new, keep)


def pair_counts(rows: DataFrame) -> DataFrame:
    """`key, n`: how many rows of aligned() have a link. Summed in tasks, then by key and salt, then by key."""
    each = rows.select(F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    return each.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def _least_common(counts: DataFrame, most: int) -> int:
    """A power of two, 2 or more, such that at most `most` pairs have that count or a larger one."""
    sizes = dict(counts.where("n > 1").groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect())  # 63 rows at most
    least, held = max(sizes, default=0) + 1, 0
    while least > 1 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 2**least


def align_report(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` per row of `docs`.

    A pair's count is the number of rows that have it linked. `n_best` counts links whose pair has the highest count of its
    A id, ties included, and `count_sum` adds the counts of all links. `groups_sha256` is of 'a1,a2|b1;a3|b2,b3'.

    Null and empty texts, and those whose tokens' bytes differ from the text's with a space before it (texts with the mark
    that B writes spaces as), have no tokens: zeros and an empty `groups_sha256`. Texts of any length are aligned whole.
    Repeated rows count each, ids may be null, other columns play no part, an empty table gives no rows.

    Pairs that only one row has are known by their absence. Of the others the most frequent ones, at most `common`, are
    broadcast; links with rarer ones are joined by a shuffle. The highest counts of A's ids, one for each, are broadcast.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = aligned(given, bpe_path, piece_path, keep=["doc_id"])
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(rows), "aligned-pairs")
    a_id = F.shiftright("key", 32)
    highest = materialise(counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("highest")), "aligned-highest")
    least = _least_common(counts, common)
    links = rows.select("rid", F.explode(F.arrays_zip("keys", "many")).alias("l")).select("rid", F.col("l.keys").alias("key"), F.col("l.many").alias("many"))
    links = links.join(F.broadcast(counts.where(F.col("n") >= least)), "key", "left")
    if least > 2:
        rare = links.where("n IS NULL").drop("n").join(counts.where((F.col("n") > 1) & (F.col("n") < least)), "key", "left")
        links = links.where("n IS NOT NULL").unionByName(rare.select(links.columns))
    links = links.withColumn("n", F.coalesce("n", F.lit(1))).join(F.broadcast(highest), a_id == F.col("a"))
    best = F.coalesce(F.sum(F.when(F.col("n") == F.col("highest"), F.col("many"))), F.lit(0))
    sums = links.groupBy("rid").agg(best.alias("n_best"), F.sum(F.col("n") * F.col("many")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.drop("keys", "many").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
