"""SentencePiece encoding and decoding (operator 12): merge-type vocabularies, exactly, by backtracking.

A merge-type encoding joins the neighbours whose joined piece has the best score until nothing joins. The result is the
only cutting of a text into pieces in which each two neighbours stay apart when their own characters are merged anew. So
the text is cut from left to right: an Aho-Corasick automaton gives the longest piece at each position, a piece that does
not stand apart from its neighbour gives way to its longest prefix among the pieces, and a position from which nothing
goes on is marked in a bitfield and never tried again. Whether two pieces stand apart is found by merging them again
backwards, undoing the later of their own merges step by step, and is kept in a table of bounded size.

Pieces of equal score (runs of spaces in the usual vocabularies) have no order among themselves but the place in the
text. They come after all others, so they are joined from the left in what the others leave over.

No piece crosses a place where a space follows something else, nor a line break (both are checked on the vocabulary), so
a text is the encodings of its segments, which are kept in a table of bounded size per task. There is no shuffle; a task
holds the tables and one batch of texts, and a task that is lost is run again.

Defined cases: a NULL text is empty; an empty text has no pieces but the begin and end ids that are asked for; characters
without a piece become their UTF-8 bytes; repeated rows are encoded each; a NULL ``doc_id`` is kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridership.llm.common import small_batches

SPACE = "▁"  # stands for a space inside pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # types of pieces
MERGES = 2  # type of the model
REPLACED = "�"  # for bytes that are no character
CACHED_SEGMENTS = 400_000
CACHED_PAIRS = 1_000_000
LONG_SEGMENT = 48  # longer ones are not kept


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class Pieces:
    """A merge-type vocabulary read from a model file: ``encode`` and ``decode``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        of = lambda n: dict(_fields(b"".join(v for k, v in fields if k == n)))
        trainer, normal = of(2), of(3)
        rows = [dict(_fields(v)) for k, v in fields if k == 1]
        if trainer.get(3) != MERGES or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge-type models with bytes for unknown characters and spaces before words")
        if normal.get(2) or not normal.get(5, 1) or normal.get(4, 1) or any(k == 5 and dict(_fields(v)).get(2) for k, v in fields):
            raise ValueError("only models that leave texts as they are")
        self.lead = SPACE if normal.get(3, 1) else ""
        self.begin, self.end, self.unknown_text = trainer.get(41, 1), trainer.get(42, 2), trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.names = [r[1].decode() for r in rows]
        self.kinds = [r.get(3, NORMAL) for r in rows]
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only normal, control and byte pieces")
        score = {n: struct.unpack("<f", r.get(2, b"\0\0\0\0"))[0] for n, r, k in zip(self.names, rows, self.kinds) if k == NORMAL}
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        merged = sorted((n for n in score if len(n) > 1), key=lambda n: -score[n])
        times = Counter(score[n] for n in merged)
        self.tied = {n for n in merged if times[score[n]] > 1}
        self._order([n for n in merged if n not in self.tied], {score[n] for n in self.tied}, score)
        self.prefixes: dict[str, str] = {}
        self.apart_known: dict[tuple[str, str], bool] = {}
        self._automaton()
        inner = {b for n in merged for b in zip(n, n[1:])}
        cut_space = not any(b == SPACE and a != SPACE for a, b in inner)
        cut_line = not any("\n" in pair for pair in inner)
        other = f"[^{SPACE * cut_space}{chr(10) * cut_line}]" if cut_space or cut_line else "[\\s\\S]"
        spaces = f"{SPACE}*{other}+|{SPACE}+" if cut_space else f"{other}+"
        self.segments = re.compile(spaces + ("|\n" if cut_line else ""))

    def _order(self, merged: list[str], tied_scores: set[float], score: dict[str, float]) -> None:
        """Rank and last merge of every piece that the merges can make."""
        if self.tied and (len(tied_scores) > 1 or any(score[n] <= min(tied_scores) for n in merged)):
            raise ValueError("pieces of equal score must come after all others")
        if any(t in n for n in merged for t in self.tied):
            raise ValueError("pieces of equal score may not be part of others")
        self.rank: dict[str, int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        for place, piece in enumerate(merged):
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if (at == 1 or left in self.rank) and (at == len(piece) - 1 or right in self.rank) and self._apart(left, right):
                    self.split[piece] = (left, right)
                    self.rank[piece] = place
                    break
            # else no merge makes the piece from better ones; in a trained vocabulary there is none
        lost = [n for n in merged if n not in self.rank]
        if lost:
            # such a piece could still be made by merges out of order, which the backward check does not see
            raise ValueError(f"{len(lost)} pieces are not made of pieces of better score")

    def _automaton(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()

    def _apart(self, left: str, right: str) -> bool:
        """Whether the characters of both, merged anew, end as these two pieces."""
        limit = len(self.ids)
        while True:
            joined = self.rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            of_left, of_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if of_left > of_right:
                limit, left = of_left, self.split[left][1]
            elif of_right >= 0:
                # an equal merge further left comes first
                limit, right = of_right + 1, self.split[right][0]
            else:
                return True

    def apart(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.apart_known.get(pair)
        if known is None:
            if len(self.apart_known) >= CACHED_PAIRS:
                self.apart_known.clear()
            known = self.apart_known[pair] = self._apart(left, right)
        return known

    def _shorter(self, piece: str) -> str:
        """The longest piece or character that the piece begins with, other than itself; empty for a character."""
        known = self.prefixes.get(piece)
        if known is None:
            known = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.rank), piece[0] if len(piece) > 1 else "")
            self.prefixes[piece] = known
        return known

    def cut(self, segment: str) -> list[str]:
        """The pieces of a segment; characters without a piece stand alone."""
        n = len(segment)
        longest = [1] * n
        for end, size in self.automaton.iter(segment):
            # of the pieces that begin at one place the longest ends last
            longest[end - size + 1] = size
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at = 0
        while at < n:
            last = out[-1] if out else None
            piece = segment[at : at + longest[at]]
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.apart(last, piece)):
                    out.append(piece)
                    at = end
                    break
                piece = self._shorter(piece)
                while not piece:
                    # nothing goes on from here: the piece before gives way
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= len(piece)
                    piece = self._shorter(piece)
                    last = out[-1] if out else None
        return self._join_tied(out) if self.tied else out

    def _join_tied(self, pieces: list[str]) -> list[str]:
        """Join what only pieces of equal score join, the leftmost first."""
        heap = [i for i in range(len(pieces) - 1) if pieces[i] + pieces[i + 1] in self.tied]
        if not heap:
            return pieces
        after = list(range(1, len(pieces) + 1))
        before = list(range(-1, len(pieces) - 1))
        whole: list[str | None] = list(pieces)
        n = len(pieces)
        while heap:
            i = heapq.heappop(heap)
            j = after[i]
            if whole[i] is None or j >= n or whole[i] + whole[j] not in self.tied:
                continue
            whole[i] += whole[j]
            whole[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if whole[i] + whole[after[i]] in self.tied:
                    heapq.heappush(heap, i)
            if before[i] >= 0 and whole[before[i]] + whole[i] in self.tied:
                heapq.heappush(heap, before[i])
        return [p for p in whole if p is not None]

    def ids_of(self, segment: str) -> list[int]:
        known = self.ids.get(segment)
        if known is not None and segment not in self.tied:
            return [known]  # a piece is what its own characters merge to
        out = []
        for piece in self.cut(segment):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    def cut_text(self, text: str) -> list[str]:
        """The segments of a text, spaces written as in pieces."""
        return self.segments.findall(self.lead + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str, begin: bool = False, end: bool = False) -> list[int]:
        ids = [i for s in self.cut_text(text) for i in self.ids_of(s)]
        return [self.begin] * begin + ids + [self.end] * end

    def text_of(self, ids: Iterable[int]) -> str:
        """Pieces side by side, spaces as in texts; a byte that belongs to no character becomes U+FFFD."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
            if self.kinds[i] != CONTROL:  # begin and end have no text, but bytes on both sides are no character
                out.append(self.unknown_text if self.kinds[i] == UNKNOWN else self.names[i].replace(SPACE, " "))
        if held:
            out.append(_characters(bytes(held)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. The space that encoding puts before a text goes, if the first piece with a text has it."""
        ids = list(ids)
        text = self.text_of(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.lead and first is not None and self.kinds[first] == NORMAL and text[:1] == " " else text


def _characters(raw: bytes) -> str:
    out = []
    at = 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + REPLACED)
            at += e.start + 1
    return "".join(out)


def encode_documents(docs: DataFrame, path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded (string: the text that the ids stand for)."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(path)
        known: dict[str, tuple[bytes, str]] = {}
        first, last = (array("I", [i] * asked).tobytes() for i, asked in ((coder.begin, begin), (coder.end, end)))

        def learn(segment: str) -> tuple[bytes, str]:
            ids = coder.ids_of(segment)
            made = array("I", ids).tobytes(), coder.text_of(ids)
            if len(segment) <= LONG_SEGMENT:
                if len(known) >= CACHED_SEGMENTS:
                    known.clear()
                known[segment] = made
            return made

        for b in batches:
            ids, texts = [], []
            for text in b.column("text").to_pylist():
                made = [known.get(s) or learn(s) for s in coder.cut_text(text or "")]
                ids.append(first + b"".join([m[0] for m in made]) + last)
                # segments begin and end between characters, so their texts are those of the whole; of the first, the
                # space before the text goes
                whole = "".join([m[1] for m in made])
                texts.append(whole[len(coder.lead) :])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
