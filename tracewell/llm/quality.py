"""Per-document text quality statistics and the verdict natural prose or not.

Method: documents longer than ``CHUNK`` characters are split into chunks that
are spread over the cluster; each chunk yields associative partial counts, with
the state of its two open ends (the cut line's counts and the cut word), so that
merging chunks gives exactly the counts of the whole text.  Chunks are merged by
tree aggregation, ``FAN`` neighbours at a time.  Shorter documents, nearly all,
are finished where they are read, without any shuffle.

Each line is judged by its own counts: prose holds function words (or Japanese
syllables) at a rate that list entries, table rows, machine output and scrambled
words do not reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536
FAN = 64
#: Least share of common words among a prose line's words.
COMMON_SHARE = 0.16
#: The same for a line that starts or ends like a sentence.
SENTENCE_SHARE = 0.08
#: Words of more letters on average are no words.
LONG_WORDS = 12
#: Least share of kana among a line's Japanese characters.
KANA_SHARE = 0.15
#: A line of at most so many different words, each used ``LEAST_REPEATED`` times, is endless repetition.
FEW_WORDS = 16
LEAST_REPEATED = 10
#: Runs of up to so many characters are kept as they are, longer ones as a digest.
EDGE = 40
#: A line's start after its indent, white space counted once: longer than any list mark and speaker.
PREFIX = 40

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
RUN = re.compile(r"(?:(?!_)[\w'’])*")
RUNS = re.compile(r"[\w'’]+")
PRIME = (1 << 61) - 1
SPACE = re.compile(r"\s+")
BREAK = re.compile(r"\r\n|\r|\n")
BULLET = re.compile(r"^\s*(?:[-*+•–—◦▪·]|#\d{1,4}[.):]?|\d{1,4}[.):]|\(\w{1,4}\)|[a-zA-Z][.)]|[ivxIVX]+[.)])\s+")
SPEAKER = re.compile(r"^\s*(?:[-*+•–—]\s+)?(?:\*\*)?\w{1,12}(?:\*\*)?\s*:\s")
KANA = re.compile(r"[぀-ヿ]")
HAN = re.compile(r"[一-鿿]")
SYMBOL = re.compile(r"[^\w\s]|_")
CELL = re.compile(r"[|\t;,<]")
END = frozenset(".!?。！？…:\"'”»)")


def _digest(run) -> list[int]:
    """[hash, bytes] of a run; the hash of a concatenation follows from those of its parts."""
    if isinstance(run, list):
        return run
    raw = run.casefold().encode("utf-8", "surrogatepass")
    return [int.from_bytes(raw, "big") % PRIME, len(raw)]


def _run(text: str):
    return text if len(text) <= EDGE else _digest(text)


def _cat(a, b):
    """The run that two neighbouring pieces of it make."""
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= EDGE:
        return a + b
    (ha, na), (hb, nb) = _digest(a), _digest(b)
    return [(ha * pow(256, nb, PRIME) + hb) % PRIME, na + nb]


def _seen(run) -> str:
    """What a run is remembered by."""
    return run.lower() if isinstance(run, str) else f"\0{run[0]}:{run[1]}"


def _start(text: str, strip: bool) -> str:
    """The first ``PREFIX`` characters, white space counted once."""
    t = text.lstrip() if strip else text
    got = t[:PREFIX]
    if got.isascii() and got.isprintable() and "  " not in got:
        return got
    got = SPACE.sub(" ", t[: 4 * PREFIX])[:PREFIX]
    return got if len(got) == PREFIX or len(t) <= 4 * PREFIX else SPACE.sub(" ", t)[:PREFIX]


def _few(runs) -> list[str]:
    return sorted(set(runs))[: FEW_WORDS + 1]


class Fragment:
    """Counts of a piece of one line, closed under concatenation."""

    __slots__ = ("chars", "words", "letters", "common", "kana", "han", "symbols", "digits", "solid", "prefix", "raw", "last", "head", "tail", "first_run", "last_run", "whole", "seen", "cells", "spaces")

    def __init__(self, text: str, common: frozenset[str], joins: bool):
        """``joins`` is false for a whole line: what only a neighbouring piece asks for is left out."""
        found = WORD.findall(text)
        self.chars = len(text)
        self.words = len(found)
        self.letters = sum(map(len, found))
        self.common = sum(map(common.__contains__, map(str.lower, found)))
        self.kana = len(KANA.findall(text)) if not text.isascii() else 0
        self.han = len(HAN.findall(text)) if not text.isascii() else 0
        self.symbols = len(SYMBOL.findall(text))
        self.digits = sum(map(str.isdigit, text))
        stripped = text.rstrip()
        self.solid = bool(stripped)
        self.prefix = _start(text, True)
        self.last = stripped[-1:]
        if joins or self.words >= LEAST_REPEATED:
            self.edges(text, joins)
        else:
            self.seen, self.first_run, self.last_run = [], "", ""
        self.cells = len(CELL.findall(text))
        self.spaces = text.count(" ")

    def edges(self, text: str, joins: bool) -> None:
        """The runs of word characters: those inside, and the two that may go on."""
        self.head = RUN.match(text, 0, EDGE + 1).group()
        self.tail = RUN.match(text[: -EDGE - 2 : -1]).group()[::-1]
        head = self.head if len(self.head) <= EDGE else RUN.match(text).group()
        tail = self.tail if len(self.tail) <= EDGE else RUN.match(text[::-1]).group()[::-1]
        self.first_run, self.last_run = _run(head), _run(tail)
        inner = RUNS.findall(text.replace("_", " "))
        if self.head and inner:
            inner.pop(0)
        if self.tail and inner:
            inner.pop()
        self.seen = _few(map(str.lower, inner)) if len(max(inner, key=len, default="")) <= EDGE else _few([_seen(_run(x)) for x in inner])
        if joins:
            self.whole = len(head) == len(text)
            self.raw = _start(text, False)

    def join(self, other: Fragment, common: frozenset[str]) -> Fragment:
        out = object.__new__(Fragment)
        for k in ("chars", "words", "letters", "common", "kana", "han", "symbols", "digits", "cells", "spaces"):
            setattr(out, k, getattr(self, k) + getattr(other, k))
        seen = {*self.seen, *other.seen}
        # a run of word characters is known once it is closed on both sides
        joint = _cat(self.last_run, other.first_run)
        if not self.whole and not other.whole and joint != "":
            seen.add(_seen(joint))
        if self.tail and other.head:
            # the cut word (and apostrophes beside it) counts as it stands in the whole text
            for text, sign in ((self.tail, -1), (other.head, -1), (self.tail + other.head, 1)):
                found = WORD.findall(text)
                out.words += sign * len(found)
                out.letters += sign * sum(map(len, found))
                out.common += sign * sum(1 for w in found if w.lower() in common)
        out.seen = _few(seen)
        out.solid = self.solid or other.solid
        out.prefix = self.prefix if len(self.prefix) == PREFIX else SPACE.sub(" ", self.prefix + other.raw)[:PREFIX] if self.prefix else other.prefix
        out.raw = self.raw if len(self.raw) == PREFIX else SPACE.sub(" ", self.raw + other.raw)[:PREFIX]
        out.last = other.last or self.last
        out.head = (self.head + other.head)[: EDGE + 1] if self.whole else self.head
        out.tail = (self.tail + other.tail)[-EDGE - 1 :] if other.whole else other.tail
        out.first_run = joint if self.whole else self.first_run
        out.last_run = joint if other.whole else other.last_run
        out.whole = self.whole and other.whole
        return out

    def dump(self) -> list:
        return [getattr(self, k) for k in self.__slots__]

    @classmethod
    def read(cls, values: list) -> Fragment:
        out = object.__new__(cls)
        for k, v in zip(cls.__slots__, values):
            setattr(out, k, v)
        return out

    def kind(self) -> str:
        """prose, list, table or junk."""
        if self.kana >= 3 and self.kana >= KANA_SHARE * (self.kana + self.han):
            return "prose"
        share = self.common / self.words if self.words else 0.0
        bullet = BULLET.match(self.prefix) is not None and SPEAKER.match(self.prefix) is None
        seen = {*self.seen, *(_seen(x) for x in (self.first_run, self.last_run) if x != "")}
        few = self.words >= LEAST_REPEATED * max(1, len(seen)) and len(seen) <= FEW_WORDS
        if not bullet and not few and self.letters <= LONG_WORDS * self.words:
            like = self.prefix[:1].isupper() or self.last in (".", "!", "?")
            if share >= COMMON_SHARE or (share >= SENTENCE_SHARE and like and self.words >= 5 and self.symbols <= 0.1 * self.letters):
                return "prose"
        if few:
            return "junk"
        if not bullet and (self.cells >= 2 or self.spaces > 0.35 * self.chars):
            return "table"
        return "list" if bullet or (self.words and self.symbols < 0.5 * self.letters and self.chars < 120) else "junk"


COUNTS = ("chars", "words", "letters", "common", "symbols", "digits", "lines", "ended", "prose", "list", "table", "junk")


class State:
    """Partial counts of a chunk: closed lines summed, the first and last line open."""

    __slots__ = ("n", "first", "last")

    def __init__(self, text: str, common: frozenset[str], joins: bool = True):
        parts = BREAK.split(text)
        self.n = dict.fromkeys(COUNTS, 0)
        self.first = Fragment(parts[0], common, joins)
        self.last = Fragment(parts[-1], common, joins) if len(parts) > 1 else None
        for line in parts[1:-1]:
            self.close(Fragment(line, common, False))

    def close(self, f: Fragment) -> None:
        n = self.n
        for k in ("chars", "words", "letters", "common", "symbols", "digits"):
            n[k] += getattr(f, k)
        if f.solid:
            n["lines"] += 1
            n["ended"] += f.last in END
            n[f.kind()] += f.chars

    def join(self, other: State, common: frozenset[str]) -> None:
        for k in COUNTS:
            self.n[k] += other.n[k]
        if self.last is None:
            self.first, self.last = self.first.join(other.first, common), other.last
        elif other.last is None:
            self.last = self.last.join(other.first, common)
        else:
            self.close(self.last.join(other.first, common))
            self.last = other.last

    def finish(self) -> dict[str, int]:
        self.close(self.first)
        if self.last is not None:
            self.close(self.last)
        return self.n

    def dump(self) -> str:
        return json.dumps([self.n, self.first.dump(), self.last.dump() if self.last else None])

    @classmethod
    def read(cls, text: str) -> State:
        out = object.__new__(cls)
        n, first, last = json.loads(text)
        out.n, out.first, out.last = n, Fragment.read(first), Fragment.read(last) if last else None
        return out


STATS = ", ".join(["doc_id long", *(f"{k} long" for k in COUNTS)])


def _stats_batch(ids: list, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in COUNTS)], names=["doc_id", *COUNTS])


def _whole(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _stats_batch(b.column(0).to_pylist(), [State(t.as_py() or "", common, False).finish() for t in b.column(1)])

    return run


def _chunked(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([State(t.as_py(), common).dump() for t in b.column(2)])], names=["doc_id", "chunk", "state"])

    return run


def _merged(common: frozenset[str], finish: bool):
    """Merge neighbouring states of sorted rows (doc_id, grp, chunk, state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            if finish:
                batch = _stats_batch([k[0] for k, _ in out], [s.finish() for _, s in out])
            else:
                batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), pa.array([s.dump() for _, s in out])], names=["doc_id", "chunk", "state"])
            out.clear()
            return batch

        for b in batches:
            for doc, grp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                piece = State.read(text.as_py())
                if (doc, grp) == key:
                    state.join(piece, common)
                else:
                    if key is not None:
                        out.append((key, state))
                    key, state = (doc, grp), piece
            if len(out) > 1000:
                yield flush()
        if key is not None:
            out.append((key, state))
        if out:
            yield flush()

    return run


def quality_counts(docs: DataFrame, common_words: Sequence[str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, counts): one row per document, exact for texts of any length.

    Null and empty texts have zero counts.  ``doc_id`` must be unique; a null
    one is a document of its own.  Other columns are not read.
    """
    common = frozenset(w.lower() for w in common_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_whole(common), STATS)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk)), lambda i: F.col("text").substr((i * chunk + 1).cast("int"), F.lit(chunk)))
    big = docs.where(F.length("text") > chunk).select("doc_id", F.posexplode(pieces).alias("chunk", "piece"))
    states = big.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "piece").repartition("doc_id", "chunk").mapInArrow(_chunked(common), "doc_id long, chunk long, state string")
    # a Spark string holds less than 2^31 characters, which bounds the levels
    level, left = 0, (1 << 31) // chunk + 1
    while left > 1:
        left = -(-left // fan)
        level += 1
        last = left <= 1
        grouped = states.select("doc_id", F.floor(F.col("chunk") / fan).alias("grp"), "chunk", "state").repartition("doc_id", "grp").sortWithinPartitions("doc_id", "grp", "chunk")
        states = grouped.mapInArrow(_merged(common, last), STATS if last else "doc_id long, chunk long, state string")
    return small.unionByName(states)


def quality_report(counts: DataFrame) -> DataFrame:
    """Ratios and rule outcomes from the counts; ratios of nothing are null."""

    def ratio(a: str, b: str):
        return F.round(F.try_divide(F.col(a), F.col(b)), 6)

    judged = F.col("prose") + F.col("list") + F.col("table") + F.col("junk")
    off = judged - F.col("prose")
    return counts.select(
        "doc_id",
        F.col("words").alias("word_count"),
        ratio("letters", "words").alias("mean_word_length"),
        ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("digits", "chars").alias("digit_ratio"),
        F.col("lines").alias("line_count"),
        ratio("ended", "lines").alias("punctuated_line_share"),
        ratio("common", "words").alias("common_word_share"),
        F.round(F.try_divide(off, judged), 6).alias("not_prose_share"),
        F.when(judged == 0, "blank")
        .when(2 * off <= judged, "prose")
        .otherwise(F.when(F.col("table") >= F.greatest("list", "junk"), "table").when(F.col("list") >= F.col("junk"), "list").otherwise("junk"))
        .alias("verdict"),
    )


def common_word_list(words: DataFrame, most: int = 100_000) -> list[str]:
    """The reference table of frequent words; refuses one too large to be such a table."""
    got = [r[0] for r in words.select("word").where("word is not null").distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} common words")
    return got
