"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

In BPE every prefix of a text has one encoding, so one last token. The table holds it for each prefix: the automaton yields
the pieces that end at a position, and the one whose predecessor's last token it is compatible with (the pair, encoded on
its own, stays that pair) is the last token there. Following the table backwards from the end gives the ids. The work is
linear in the text; nothing is merged step by step, except once for each distinct pair that is tested.

The model file's own settings are used: a dummy prefix, white space kept, an identity normalizer, bytes for characters that
have no piece. No piece holds a blank after another character, so texts are cut before runs of blanks, and the encoding of
a cut is remembered in a cache of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; texts of any length are encoded whole;
repeated rows are answered alike; an empty table gives no rows; other columns are kept by ``encode`` and ignored by the
query.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import memory, table, text_batches

BLANK = "▁"
#: Cuts of the young generation that a worker remembers; when it is full it becomes the old one, whose cuts go unless they
#: are met again.
CACHE = 200_000
#: Pairs of tokens a worker remembers.
PAIRS = 2_000_000
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Codec:
    """Encoder and decoder of one model file."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        import ahocorasick

        self.piece: list[str] = []
        self.kind: list[int] = []
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.value: dict[int, int] = {}
        for number, message in _fields(open(path, "rb").read()):
            if number != 1:
                continue
            entry = dict(_fields(message))
            name, kind, i = entry.get(1, b"").decode(), entry.get(3, self.NORMAL), len(self.piece)
            self.piece.append(name)
            self.kind.append(kind)
            if kind == self.BYTE:
                self.byte[int(name[3:5], 16)] = i
                self.value[i] = int(name[3:5], 16)
            elif kind in (self.NORMAL, self.USER, self.UNUSED):
                self.id[name] = i
                self.score[name] = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
        self.automaton = ahocorasick.Automaton()
        self.sizes = [len(name) for name in self.piece]
        #: For each piece: whether it stays whole behind another piece (by its id), or at the start of a cut (-1).
        self.after: dict[int, dict[int, bool]] = {i: {} for i in self.id.values()}
        self.n_after = 0
        for name, i in self.id.items():
            self.automaton.add_word(name, (i, len(name), self.after[i]))
        self.automaton.make_automaton()
        self.neighbours = {name[i : i + 2] for name in self.id for i in range(len(name) - 1)}
        if any(BLANK in name.lstrip(BLANK) for name in self.id):
            raise ValueError("a piece holds a blank inside; texts can't be cut at blanks")
        inside = {c for name in self.id if len(name) > 1 for c in name}
        #: Cuts begin at runs of blanks; where no piece holds a line's end, runs of these are cuts of their own.
        self.cut_pattern = re.compile("▁+[^▁\n]*|\n+|[^▁\n]+" if "\n" not in inside else "▁+[^▁]*")
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Ids joined by commas; with what they decode to, if that isn't the cut.
        self.cuts: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    # ------------------------------------------------------------ encoding

    def merge(self, text: str) -> list[str]:
        """BPE as it is defined: the best-scored neighbours first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def tokens(self, text: str) -> list[str]:
        """The tokens of a cut: the last token of every prefix, then backwards. For characters without a piece too."""
        n = len(text)
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, i in self.automaton.iter(text):
            ends[end].append(len(self.piece[i]))
        last: list[str] = [""] * (n + 1)
        for i in range(1, n + 1):
            for size in (*ends[i - 1], 1):
                token, before = text[i - size : i], last[i - size]
                if self._whole(token) if size == i else before and self.compatible(before, token):
                    last[i] = token
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def piece_ids(self, text: str) -> list[int] | None:
        """As tokens, by ids; None if a prefix has no last token among the pieces."""
        n = len(text)
        last = [-1] * (n + 1)
        for end, (piece, size, after) in self.automaton.iter(text):  # longest first at each end
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if before >= 0 or end == size:
                    known = after.get(before)
                    if known is None:
                        known = self._pair(before, piece, after)
                    if known:
                        last[end] = piece
        out, at, size_of = [], n, self.sizes
        while at > 0:
            piece = last[at]
            if piece < 0:
                return None
            out.append(piece)
            at -= size_of[piece]
        out.reverse()
        return out

    def _pair(self, before: int, piece: int, after: dict[int, bool]) -> bool:
        if self.n_after >= PAIRS:
            for known in self.after.values():
                known.clear()
            self.n_after = 0
        self.n_after += 1
        name = self.piece[piece]
        after[before] = known = self._whole(name) if before < 0 else self.merge(self.piece[before] + name) == [self.piece[before], name]
        return known

    def _whole(self, piece: str) -> bool:
        """Whether a piece on its own stays whole."""
        key = ("", piece)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merge(piece) == [piece]
        return known

    def cut_ids(self, cut: str) -> list[int]:
        # Pieces of blanks alone share one score, so for runs of blanks the order of merges matters: merge those as defined.
        head = len(cut) - len(cut.lstrip(BLANK))
        if head < 2:
            got = self.piece_ids(cut)
            if got is not None:
                return got
            tokens = self.tokens(cut)
        else:
            tokens = self.merge(cut) if len(cut) < 128 else self._long_run(cut)
        ids: list[int] = []
        for t in tokens:
            i = self.id.get(t)
            if i is None:
                ids.extend(self.byte[b] for b in t.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return ids

    def _long_run(self, cut: str) -> list[str]:
        """A long run of blanks, or one before a very long cut: as merge, by a queue of pairs."""
        import heapq

        parts: list[str | None] = list(cut)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                both = parts[i] + parts[j]
                s = self.score.get(both)
                if s is not None:
                    heapq.heappush(queue, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def split(self, text: str) -> list[str]:
        """The cuts of a text, blanks written as the model writes them."""
        return self.cut_pattern.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def known(self, cut: str) -> str | tuple[str, str]:
        """Ids of a cut, joined by commas; with what they decode to, if that isn't the cut."""
        got = self.cuts.get(cut)
        if got is None:
            got = self.older.get(cut)
            if got is None:
                got = self._coded(cut)
                if len(cut) >= 256:
                    return got
            if len(self.cuts) >= CACHE:
                self.older, self.cuts = self.cuts, {}
            self.cuts[cut] = got
        return got

    def _coded(self, cut: str) -> str | tuple[str, str]:
        parts = self.sections(cut)
        if len(parts) > 1:
            ids, surface = self._joined(parts, list(map(self.known, parts)))
        else:
            numbers = self.cut_ids(cut)
            ids, surface = ",".join(map(str, numbers)), self.surface(numbers)
        return ids if surface == cut else (ids, surface)

    @staticmethod
    def _joined(cuts: list[str], got: list[str | tuple[str, str]]) -> tuple[str, str]:
        if tuple not in set(map(type, got)):
            return ",".join(got), "".join(cuts)
        both = [(x, cut) if isinstance(x, str) else x for cut, x in zip(cuts, got, strict=True)]
        return ",".join(ids for ids, _ in both), "".join(surface for _, surface in both)

    def coded(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, what they decode to) of a whole text."""
        cuts = self.split(text)
        if not cuts:
            return "", 0, ""
        get, known = self.cuts.get, self.known
        ids, surface = self._joined(cuts, [get(cut) or known(cut) for cut in cuts])
        return ids, ids.count(",") + 1, self.spaced(surface)

    def sections(self, cut: str) -> list[str]:
        """A cut, cut again between neighbours that no piece holds: no merge can cross there."""
        near, at, out = self.neighbours, 0, []
        if all(map(near.__contains__, map(add, cut, cut[1:]))):
            return [cut]
        for i in range(1, len(cut)):
            if cut[i - 1 : i + 1] not in near:
                out.append(cut[at:i])
                at = i
        out.append(cut[at:])
        return out

    def encode(self, text: str) -> list[int]:
        return [i for cut in self.split(text) for part in self.sections(cut) for i in self.cut_ids(part)]

    # ------------------------------------------------------------ decoding

    def surface(self, ids: list[int]) -> str:
        """The characters of ids, blanks as the model writes them; bytes that form no character become U+FFFD each."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == self.BYTE:
                run.append(self.value[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            out.append(" ⁇ " if kind == self.UNKNOWN else "" if kind == self.CONTROL else self.piece[i])
        if run:
            out.append(_characters(bytes(run)))
        return "".join(out)

    @staticmethod
    def spaced(surface: str) -> str:
        """The decoded text: the dummy prefix goes, blanks become spaces."""
        return surface.removeprefix(BLANK).replace(BLANK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.spaced(self.surface(ids))


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


_codecs: dict[str, Codec] = memory()


def codec(path: str) -> Codec:
    """One codec for each Python worker and model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of a text column."""
    path = path or model_path()
    text_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.encode(t) if t else [] for t in texts])

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of an id column."""
    path = path or model_path()

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series(["" if v is None else c.decode(list(v)) for v in values])

    return df.withColumn(out, texts(F.col(ids)))


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id with the number and digest of its ids and the digest of what they decode to, in one pass."""
    path = path or model_path()
    text_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            rows = []
            for t in batch[text]:
                ids, n, back = c.coded(t or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
