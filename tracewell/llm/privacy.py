"""Personal information inside free text.

Method: information-theoretic sanitisation.  How strongly a term reveals a
protected entity - a person - is estimated from the whole corpus: of a term's
occurrences, the share that stands in a name's slot (directly beside a part of
the reference name list), against the share of all terms.  Terms that disclose
at least ``BITS`` are name parts, also if the incomplete list lacks them; listed
names that are really plain words disclose little in this corpus and are let
go.  E-mail addresses, phone and identity numbers and street addresses have
forms of their own, which patterns tell without the corpus.  Findings are
generalised to typed placeholders in the same pass.

Corpus counts are combined inside each batch before the shuffle.  The term
table is broadcast only if it has at most ``LEXICON_TERMS`` terms (about 64 MB);
of a larger one each row gets the terms it holds by a join, and the same search
runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import written

#: A term is a name part if its slot share has this much lift, in bits ...
BITS = 3.0
#: ... and is at least this, after one occurrence of each kind is added for listed names.
SLOT_SHARE = 0.15
#: Least occurrences in a slot for a term that is not listed.
SUPPORT = 2
LEXICON_TERMS = 1_000_000

L = r"[^\W\d_]"
PART = rf"{L}+(?:[’']{L}+)*"
TOKEN = re.compile(rf"{PART}(?:-{PART})*")

# forms of e-mail addresses, plain and spelled out
_AT = r"(?:@|\s?[(\[]\s?(?:at|AT|arroba)\s?[)\]]\s?|\s(?:AT|at|arroba)\s)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|DOT|punkt|punto|point)\s?[)\]]\s?|\s(?:DOT|dot|punkt|punto|point)\s)"
EMAIL = re.compile(rf"(?<![\w.+%@/-])[\w+%-]+(?:\.[\w+%-]+)*(?P<at>{_AT})[\w-]+(?:{_DOT}[\w-]+)*(?:{_DOT}[^\W\d_]{{2,}})(?![\w@])")
SPELLED = re.compile(r"\s(?:DOT|dot|punkt|punto|point)\s|[(\[]")
EMAIL_HINT = re.compile(r"@|[(\[]\s?(?:at|AT|arroba)\s?[)\]]|\s(?:AT|at|arroba)\s[\w-]+\s(?:DOT|dot|punkt|punto|point)\s")

# forms of phone numbers, longest first
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?\(0\)[ ]?\d{2,5}(?:[ .-]?\d{2,}){1,3}"
    r"|\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\+\d(?:[ .-]?\d){7,14}"
    r"|00\d{2}(?:[ ./-]?\d){7,12}"
    r"|\(\d{2,5}\)[ ]?\d{3,4}[ .-]?\d{3,4}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r"|0\d{2,4} \d{3,4} \d{4}|0\d{3,4} \d{6}"
    r"|0\d{2,4}[/-]\d{5,9}"
    r")(?![\w]|[.-]\d)"
)
DIGITS = re.compile(r"\d(?:[ ()./A-Z-]{0,3}\d){5}")

# forms of identity numbers: 8 digits and a letter, national insurance, eleven-digit tax, social security, card serials
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:"
    r"\d{8}-?[A-Z]"
    r"|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{2} \d{3} \d{3} \d{3}|(?<=ID )\d{11}"
    r"|\d{3}[- ]\d{2}[- ]\d{4}"
    r"|[CFGHJKLMNPRTVWXYZ](?=[A-Z]*\d)(?:\d|[CFGHJKLMNPRTVWXYZ](?=\d|[CFGHJKLMNPRTVWXYZ]*\d)){7}\d"
    r")(?![\w]|-\d)"
)

# forms of street addresses, each with its town
_U = r"[^\W\d_a-zß-öø-ÿ]"
_W = rf"{_U}[\w’'-]*"
_TOWN = rf"{_W}(?:[ -]{_W}){{0,2}}"
_EN_TYPE = r"(?:Street|Road|Lane|Avenue|Boulevard|Close|Way|Terrace|Drive|Court|Place|Square|Crescent|Hill|Row|St|Rd|Ln|Ave|Blvd|Ter|Dr|Ct|Pl|Sq)"
_UNIT = r"(?:,? ?(?:Apt|Apartment|Flat|Unit|Suite|Ste|Floor|#)\.? ?\w+)?"
ADDRESS = re.compile(
    rf"(?<![\w/-])(?:"
    rf"\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}{_EN_TYPE}\b\.?{_UNIT},? {_TOWN},? (?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})\b"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|impasse|place|allée|chemin|boulevard|bd|quai|cours|route|square|passage)(?: (?:de|du|des|la|le|les|aux?|l[’']|d[’']))* ?{_W}(?:[ -](?:(?:de|du|des|la|le|les)[ -])?{_W}){{0,3}}, \d{{5}} {_TOWN}"
    rf"|(?:Calle|C/|Plaza|Pza\.?|Avda\.?|Avenida|Paseo|Camino|Ronda|Carrera|Travesía)(?: (?:de|del|la|las|los|el))* {_W}(?: (?:(?:de|del|la|las|los) )?{_W}){{0,3}},? \d{{1,4}}(?:, ?[^,;\n]{{1,12}})?, \d{{5}} {_TOWN}"
    rf"|(?:(?:Am|An|Auf|Bei|Hinter|Im|In|Unter|Vor|Zum|Zur|Obere[rn]?|Untere[rn]?|Alte[rn]?|Neue[rn]?|Große[rn]?|Kleine[rn]?)(?: (?:der|dem|den))? )?{_W} \d{{1,4}} ?[a-z]?, \d{{5}} {_TOWN}"
    rf")"
)
_MAIL = frozenset("@._+%0123456789")
POSTCODE = re.compile(r"\b\d{5}\b|\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b")

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def _free(spans: list[tuple], a: int, b: int) -> bool:
    return all(b <= s or a >= e for s, e, _ in spans)


def form_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that shows by its form."""
    spans: list[tuple[int, int, str]] = []
    if EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            # host:path is a repository, not a mailbox
            if text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].strip():
                continue
            # a plain "at" is a word like any other unless a spelled-out dot follows
            if m["at"].strip() != "at" or SPELLED.search(text, m.end("at"), m.end()):
                spans.append((m.start(), m.end(), "email"))
    if POSTCODE.search(text):
        for m in ADDRESS.finditer(text):
            if _free(spans, m.start(), m.end()):
                spans.append((m.start(), m.end(), "address"))
    for pattern, kind in ((ID_NUMBER, "id_number"), (PHONE, "phone")) if DIGITS.search(text) else ():
        for m in pattern.finditer(text):
            if _free(spans, m.start(), m.end()):
                spans.append((m.start(), m.end(), kind))
    return spans


def name_pairs(text: str, toks: list[re.Match]) -> Iterator[tuple[int, int, bool]]:
    """(first token, last token, family first?) for every ``A B``, ``A I. B`` and ``B, A`` of a text, in order."""
    for i, a in enumerate(toks[:-1]):
        b = toks[i + 1]
        gap = text[a.end() : b.start()]
        if gap == " ":
            yield i, i + 1, False
            if len(b[0]) == 1 and i + 2 < len(toks) and text[b.end() : toks[i + 2].start()] in (". ", " "):
                yield i, i + 2, False
        elif gap == ", ":
            yield i, i + 1, True


def parts_of(token: str) -> list[str]:
    return token.lower().split("-")


def _lexicons(batch: pa.RecordBatch, shared: Mapping[str, set[str]] | None) -> Iterator[tuple[pa.RecordBatch, Mapping[str, set[str]]]]:
    """(rows, terms they are searched with): the shared ones, or those that each row brings in ``terms``."""
    if shared is not None:
        yield batch, shared
        return
    for i, terms in enumerate(batch.column("terms")):
        own: dict[str, set[str]] = {}
        for t in terms.as_py() or ():
            own.setdefault(t["term"], set()).add(t["slot"])
        yield batch.slice(i, 1), own


def _counter(shared: Mapping[str, set[str]] | None):
    """mapInArrow step: (term, other, slot, n): occurrences of terms, and of terms beside listed names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[tuple] = Counter()
            for text, listed in ((t, own) for part, own in _lexicons(batch, shared) for t in _texts(part)):
                words = [p for w in TOKEN.findall(text) for p in (w.lower().split("-") if "-" in w else (w.lower(),))]
                n.update((w, "", "") for w in words)
                if listed.keys().isdisjoint(words):
                    continue
                toks = list(TOKEN.finditer(text))
                for i, a in enumerate(toks[:-1]):
                    j = i + 1
                    gap = text[a.end() : toks[j].start()]
                    if gap == " " and len(toks[j][0]) == 1 and j + 1 < len(toks) and text[toks[j].end() : toks[j + 1].start()] in (". ", " "):
                        j += 1
                    elif gap != " ":
                        continue
                    # the start of a mail address is no name
                    if text[toks[j].end() : toks[j].end() + 1] in _MAIL and toks[j].end() < len(text):
                        continue
                    # "B, A next" and "before B, A" are not the pair (A, next) or (before, B)
                    if i and text[toks[i - 1].end() : a.start()] == ", ":
                        continue
                    if j + 1 < len(toks) and text[toks[j].end() : toks[j + 1].start()] == ", ":
                        nxt = parts_of(toks[j + 1][0])[0]
                        if "given" in listed.get(nxt, ()):
                            continue
                    for x in parts_of(a[0]):
                        for y in parts_of(toks[j][0]):
                            if "given" in listed.get(x, ()):
                                n[(y, x, "family")] += 1
                            if "family" in listed.get(y, ()):
                                n[(x, y, "given")] += 1
            rows = list(n.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())],
                names=["term", "other", "slot", "n"],
            )

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for content, texts in zip(batch.column("content"), batch.column("texts")):
        if (c := content.as_py()) is not None:
            yield c
        yield from (t for t in (texts.as_py() or ()) if t is not None)


def disclosure(rows: DataFrame, names: DataFrame, most: int = LEXICON_TERMS) -> DataFrame:
    """(term, slot, n, share, bits): how strongly each term of the corpus reveals a person.

    ``rows`` has content and texts; ``names`` is the reference list (name_kind,
    name).  First the listed names are weighed by how often they stand beside
    each other; the reliable ones are the seeds that weigh all other terms.  A
    list of more than ``most`` names is not held by the workers: each row gets the
    listed names it holds by a join.
    """
    listing = names.where("name is not null").select(F.lower("name").alias("term"), F.col("name_kind").alias("listed")).distinct()
    schema = "term string, other string, slot string, n long"
    reference = listing.limit(most + 1).collect()
    if len(reference) <= most:
        listed: dict[str, set[str]] = {}
        for r in reference:
            listed.setdefault(r["term"], set()).add(r["listed"])
        counted = rows.select("content", "texts").mapInArrow(_counter(listed), schema)
    else:
        counted = with_own_terms(rows, listing.withColumnRenamed("listed", "slot")).mapInArrow(_counter(None), schema)
    table = written(counted.groupBy("term", "other", "slot").agg(F.sum("n").alias("n")), "terms")
    total = table.where("slot = ''").select("term", F.col("n").alias("total"))
    beside = table.where("slot <> ''")
    own = beside.join(listing.withColumnRenamed("listed", "slot"), ["term", "slot"]).groupBy("term").agg(F.sum("n").alias("near"))
    seeds = listing.join(total, "term").join(own, "term", "left").where((F.coalesce("near", F.lit(0)) + 1) / (F.col("total") + 2) >= SLOT_SHARE).select("term", "listed")
    seeds = written(seeds, "seeds")
    by_seed = beside.join(seeds.select(F.col("term").alias("other"), F.lit(True).alias("seed")).distinct(), "other").groupBy("term", "slot").agg(F.sum("n").alias("near"))
    all_terms, all_near = table.where("slot = ''").agg(F.sum("n")).scalar(), by_seed.agg(F.sum("near")).scalar()
    bits = F.log2(F.try_divide(F.col("near") * all_terms, F.col("total") * all_near))
    weighed = by_seed.join(total, "term").select("term", "slot", "near", F.col("total").alias("n"), F.try_divide("near", "total").alias("share"), bits.alias("bits"))
    known = seeds.select("term", F.col("listed").alias("slot"), F.lit(True).alias("listed"))
    return weighed.join(known, ["term", "slot"], "full_outer")


def name_terms(weights: DataFrame) -> DataFrame:
    """(term, slot) of the terms that exceed the disclosure thresholds."""
    return weights.where(f"listed or (near >= {SUPPORT} and share >= {SLOT_SHARE} and bits >= {BITS} and length(term) > 1)").select("term", "slot").distinct()


def name_spans(text: str, taken: list[tuple], lexicon: Mapping[str, set[str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of every person's name: pairs of a given and a family name from left to right, with all further parts.

    A pair that starts inside a name already found is not taken; neither is one
    that overlaps ``taken``.  A name goes on over given names before it and family
    names after it (``A A B``, ``A B B``), or given names after it (``B, A A``).
    """
    if lexicon.keys().isdisjoint(re.findall(PART, text.lower())):
        return
    toks = list(TOKEN.finditer(text))

    def holds(n: int, slot: str) -> bool:
        return all(slot in lexicon.get(p, ()) for p in parts_of(toks[n][0]))

    def beside(n: int) -> bool:
        return text[toks[n].end() : toks[n + 1].start()] == " "

    done = 0
    for i, j, family_first in name_pairs(text, toks):
        a, b = toks[i].start(), toks[j].end()
        given, family = (j, i) if family_first else (i, j)
        if a < done or not holds(given, "given") or not holds(family, "family") or not _free(taken, a, b):
            continue
        while not family_first and i and beside(i - 1) and toks[i - 1].start() >= done and holds(i - 1, "given") and _free(taken, toks[i - 1].start(), b):
            i -= 1
        more = "given" if family_first else "family"
        while j + 1 < len(toks) and beside(j) and holds(j + 1, more) and _free(taken, a, toks[j + 1].end()):
            j += 1
        done = toks[j].end()
        yield toks[i].start(), done


def find_spans(text: str, lexicon: Mapping[str, set[str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece of personal data of a text."""
    spans = form_spans(text)
    return spans + [(a, b, "name") for a, b in name_spans(text, spans, lexicon)]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, kind in sorted(spans, reverse=True):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


FOUND = {"row_id": ("long", pa.int64()), "block_no": ("int", pa.int32()), "kind": ("string", pa.string()), "start_pos": ("long", pa.int64()), "end_pos": ("long", pa.int64())}
CLEAN = {"row_id": ("long", pa.int64()), "block_no": ("int", pa.int32()), "text": ("string", pa.string())}


def _units(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row_id, block_no, text) of the texts of a batch that are not null."""
    for rid, content, texts in zip(batch.column("row_id").to_pylist(), batch.column("content"), batch.column("texts")):
        for no, text in [(-1, content.as_py()), *enumerate(texts.as_py() or ())]:
            if text is not None:
                yield rid, no, text


def _searcher(shared, clean: bool):
    """mapInArrow step over rows (row_id, content, texts[, terms]): spans, or the texts with placeholders.

    The lexicon is shared, or each row brings the terms it holds.
    """
    columns = CLEAN if clean else FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, lexicon in _lexicons(batch, shared.value if shared is not None else None):
                for rid, no, text in _units(part):
                    spans = find_spans(text, lexicon)
                    if clean:
                        out.append((rid, no, mask(text, spans)))
                    else:
                        out += [(rid, no, kind, a + 1, b) for a, b, kind in spans]
            cols = list(zip(*out)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns.values())], names=list(columns))

    return run


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, term): the distinct name-like terms of each row's texts."""
    for batch in batches:
        pairs = [(u, p) for u, c, ts in zip(batch.column("unit").to_pylist(), batch.column("content"), batch.column("texts")) for p in {p for t in (c.as_py(), *(ts.as_py() or ())) if t for w in TOKEN.findall(t) for p in parts_of(w)}]
        cols = list(zip(*pairs)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["unit", "term"])


def text_units(messages: DataFrame) -> DataFrame:
    """(row_id, content, texts): the texts of a row; texts[i] is that of block i."""
    return messages.select(F.col("row_id").cast("long").alias("row_id"), "content", F.transform("blocks", lambda b: b["text"]).alias("texts"))


def with_own_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, content, texts, terms): each row with those of the terms (term, slot) that its texts hold."""
    rows = written(rows.select("row_id", "content", "texts").withColumn("unit", F.monotonically_increasing_id()), "units")
    own = rows.mapInArrow(_own_terms, "unit long, term string").join(terms, "term").groupBy("unit").agg(F.collect_list(F.struct("term", "slot")).alias("terms"))
    return rows.join(own, "unit", "left").select("row_id", "content", "texts", "terms")


def _search(messages: DataFrame, names: DataFrame, lexicon_terms: int, clean: bool) -> DataFrame:
    rows = text_units(messages)
    terms = written(name_terms(disclosure(rows, names, lexicon_terms)), "lexicon")
    columns = CLEAN if clean else FOUND
    schema = ", ".join(f"{c} {t}" for c, (t, _) in columns.items())
    if terms.count() <= lexicon_terms:
        lexicon: dict[str, set[str]] = {}
        for r in terms.collect():
            lexicon.setdefault(r["term"], set()).add(r["slot"])
        shared = messages.sparkSession.sparkContext.broadcast(lexicon)
        return rows.mapInArrow(_searcher(shared, clean), schema)
    # the same search, each row with its own terms
    return with_own_terms(rows, terms).mapInArrow(_searcher(None, clean), schema)


def find_personal(messages: DataFrame, names: DataFrame, lexicon_terms: int = LEXICON_TERMS) -> DataFrame:
    """(row_id, block_no, kind, start_pos, end_pos): every piece of personal data.

    Positions count code points from 1, the end included.  Null and empty texts
    hold none; repeated rows are each searched; of overlapping pieces the form
    (mail, address, number) precedes the name.
    """
    return _search(messages, names, lexicon_terms, clean=False)


def sanitise(messages: DataFrame, names: DataFrame, lexicon_terms: int = LEXICON_TERMS) -> DataFrame:
    """(row_id, block_no, text): every text of a row, personal data replaced by typed placeholders where it is found."""
    return _search(messages, names, lexicon_terms, clean=True)
