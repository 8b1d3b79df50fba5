"""Personal data: patterns for entities, and corpus co-occurrence for what reveals them.

Entities are e-mail addresses, IP addresses, card and phone numbers found by fixed
patterns in whole texts. Which other terms reveal them is learned from the corpus: an
entity's context is what its line has within ``REACH`` characters of it, and the
disclosure of entity e by term t is

    PMI(e; t) / IC(e) = log(n(e,t) N / (n(e) n(t))) / log(N / n(e)),

1 if t never occurs without e and 0 if they are independent; n(e) and n(e,t) count
contexts, n(t) lines with the term (at least n(e,t)) and N all lines, repeated ones
as often as they occur. Terms seen in at least ``SUPPORT`` different contexts of an
entity are generalised (written as ``[term]``) from a disclosure of ``GENERALISE`` on,
and removed from ``REMOVE`` on, in the entity's contexts. Copies of one context are no
support. Entities themselves become ``[email]`` and so on.

Counts are partial sums that meet by key. Only terms with enough support beside an
entity are counted over the corpus. A hot entity or term is one row per task.

Null texts are read as empty; empty texts have no entities. Rows are judged one by
one (repeated rows repeat); a null id is kept. With no
term above a threshold only the patterns act. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.llm.ids import sized
from tripmine.llm.shingles import rows_of
from tripmine.workspace import as_table

SUPPORT, GENERALISE, REMOVE, REACH = 3, 0.6, 0.8, 200
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    """The e-mail pattern, entered at each @ so that long runs of letters cost one pass."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def entities(text: str) -> list[Span]:
    """(start, end, kind) of every entity, by start, then kind as listed."""
    found = list(_emails(text))
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _context(text: str, span: Span) -> tuple[int, int]:
    """Bounds of a span's context; words at its ends are whole."""
    start, end = span[:2]
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    low = max(low, text.rfind("\n", low, start) + 1)
    after = text.find("\n", end, high)
    high = high if after < 0 else after
    while low < start and low and text[low - 1].isalpha() and text[low].isalpha():
        low += 1
    while high > end and high < len(text) and text[high].isalpha() and text[high - 1].isalpha():
        high -= 1
    return low, high


def _beside(spans: list[Span], i: int) -> list[Span]:
    """Entities that may lie in the context of the i-th; each has at least six characters."""
    return spans[max(0, i - REACH) : i + REACH]


def _name(text: str, span: Span) -> str:
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] == 'email' else re.sub('[ ().-]', '', value) if span[2] != 'ip' else value}"


def _terms(text: str, start: int, end: int, spans: list[Span]) -> dict[str, list[tuple[int, int]]]:
    """Places of each term between two positions, outside the given entities."""
    out: dict[str, list[tuple[int, int]]] = {}
    for m in _TERM.finditer(text, start, end):
        if not any(a < m.end() and m.start() < b for a, b, _ in spans):
            out.setdefault(m[0].lower(), []).append((m.start(), m.end()))
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = []
        for text in (t.as_py() or "" for t in batch.column(0)):
            spans = entities(text)
            for i, span in enumerate(spans):
                start, end = _context(text, span)
                terms = sorted(_terms(text, start, end, _beside(spans, i)))
                rows.append((_name(text, span), text[start:end], terms))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entity", "context", "terms"]
        )


def disclosures(docs: DataFrame) -> DataFrame:
    """``entity, term, disclosure`` of every term at or above the lower threshold."""
    seen = docs.select("text").mapInArrow(_contexts, "entity string, context string, terms array<string>")
    seen = seen.select("entity", F.xxhash64("context").alias("at"), "terms")
    seen = seen.groupBy("entity", "at").agg(F.count("*").alias("n"), F.min("terms").alias("terms"))
    seen = as_table(seen, "contexts")
    of_entity = seen.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("of"))
    of_entity = of_entity.where(f"of >= {SUPPORT}").drop("of")
    pairs = seen.join(of_entity, "entity").select("entity", "n_e", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("of"))
    pairs = as_table(pairs.where(f"of >= {SUPPORT}").drop("of"), "pairs")
    wanted = as_table(pairs.select("term").distinct(), "wanted")
    schema = "entity string, term string, disclosure double"
    if not wanted.take(1):
        return docs.sparkSession.createDataFrame([], schema)
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    number = max(docs.select(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0, 2)
    words = lines.select(F.explode(F.array_distinct(F.split(F.lower("line"), r"[^\p{L}]+"))).alias("term"))
    # counted where the lines are read; one row per term and task is moved
    of_term = words.join(sized(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    pmi = F.log(F.col("n_et") * float(number) / (F.col("n_e") * F.greatest("n_t", "n_et")))
    # an entity met as often as there are lines is no secret: no term discloses it
    secret = F.log(float(number) / F.col("n_e"))
    share = F.when(F.col("n_e") < float(number), pmi / secret).otherwise(0.0)
    scored = pairs.join(of_term, "term").withColumn("disclosure", share)
    return as_table(scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"), "disclosures")


_OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, clean string"


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = []
        for doc_id, text, rules in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            spans = entities(text)
            revealing = {(r["entity"], r["term"]): r["disclosure"] for r in rules or ()}
            added: dict[tuple[int, int], float] = {}
            for i, span in enumerate(spans if revealing else ()):
                start, end = _context(text, span)
                for term, places in _terms(text, start, end, _beside(spans, i)).items():
                    share = revealing.get((_name(text, span), term))
                    if share is not None:
                        for place in places:
                            added[place] = max(share, added.get(place, 0.0))
            every = sorted([*spans, *((a, b, "term") for a, b in added)], key=lambda s: (s[0], KINDS.index(s[2])))
            clean, at = [], 0
            for start, end, kind in every:
                if start >= at:
                    clean += [text[at:start], "" if added.get((start, end), 0.0) >= REMOVE and kind == "term" else f"[{kind}]"]
                at = max(at, end)
            joined = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
            n = [sum(s[2] == k for s in spans) for k in KINDS[:4]]
            rows.append((doc_id, *n, joined(spans), joined(every), "".join([*clean, text[at:]])))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (*[pa.int64()] * 5, *[pa.string()] * 3)
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "clean"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def sanitise(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): counts, ``base`` and all ``spans``, and the ``clean`` text.

    Spans are ``kind:start:end`` in code points, by start, then kind, joined by commas.
    """
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    rules = disclosures(own)
    none = F.lit(None).cast("array<struct<entity:string,term:string,disclosure:double>>")
    if not rules.take(1):
        return own.select("doc_id", "text", none.alias("rules")).mapInArrow(_sanitise, _OUT)
    schema = "doc_id bigint, mark bigint, entity string"
    marked = own.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    held = as_table(marked.mapInArrow(_mentions, schema).distinct(), "mentions").join(rules, "entity")
    held = held.groupBy("mark").agg(F.collect_set(F.struct("entity", "term", "disclosure")).alias("rules"))
    held = sized(as_table(held, "rules"))
    return marked.join(held, "mark", "left").select("doc_id", "text", "rules").mapInArrow(_sanitise, _OUT)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = []
        for doc_id, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(doc_id, mark, _name(text, s)) for s in entities(text or "")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "mark", "entity"]
        )
