"""Personal data: fixed patterns, and terms that reveal protected entities by corpus co-occurrence.

Base kinds (email, ip, card, phone) are found by pattern. Every distinct value found is a
protected entity. The method then asks of each term in an entity's sentence how much it gives away:

    disclosure(e, t) = PMI(e; t) / IC(e) = log2(P(e|t) N / df(e)) / log2(N / df(e))

df counts documents over the whole corpus. P(e|t) is not the bare share df(e,t) / df(t) (df(e,t): documents
with t in a sentence of e) but the lower end of its Wilson interval, so one or two documents count for what
they prove and many count in full. Copies of one sentence are one case in both numbers. The figure nears 1
where the term occurs only beside the entity and is 0 or less where the two are independent. In the documents
that hold the entity, terms from ``remove_at`` on are removed and from ``generalise_at`` on generalised.
A sentence ends at a line's end, at ``.!?`` before a blank, and after ``sentence_words`` words.

Plan: one pass finds patterns and contexts (no shuffle) and keeps the text of those rows only that hold an
entity; one pass counts document frequencies (per-task counts are added before the shuffle); the pairs are
ordinary aggregations. Only rows with an entity are joined with flagged terms, and only by the words that they
have, so the corpus' text never moves and a frequent entity's terms do not meet all of its rows.

Edge cases: a null text is an empty text, without spans; very long texts are read whole and every scan is
linear in the text; repeated rows get equal results; null ids keep their rows; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import spare, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
ORDER = {k: i for i, k in enumerate((*KINDS, TERM))}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?]+(?=\s)|\n")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


@dataclass(frozen=True)
class Rules:
    sentence_words: int = 256
    support: int = 1
    z: float = 1.645  # one-sided 95 %
    generalise_at: float = 0.5
    remove_at: float = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Walks from one @ to the next, so a long run of letters costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every pattern that holds, in the order of start, then kind."""
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """One name for the ways in which a value is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def contexts(text: str, spans: list[tuple[str, int, int]], most: int) -> list[tuple[list[str], int, list[str]]]:
    """(entities, context hash, terms) of each sentence with a span; the entities are its values.

    A kind is no entity: its mask stays in the text and tells it anyway, and ordinary words beside many addresses reveal none of them.

    Words of the spans themselves are no terms. Linear in the text, since a sentence has ``most`` words at most.
    """
    if not spans:
        return []
    ends = [m.end() for m in END.finditer(text)]
    covered: list[tuple[int, int]] = []
    for _, a, b in spans:
        if covered and a < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    starts, sentences, words = [a for a, _ in covered], [], []
    number, size, last, part = [], 0, -1, 0
    for m in WORD.finditer(text):
        at = bisect_right(ends, m.start())
        part, size = (0, 0) if at != last else (part + 1, 0) if size == most else (part, size)
        last, size = at, size + 1
        words.append(m.start())
        number.append((at, part))
        k = bisect_right(starts, m.end() - 1) - 1
        if k < 0 or covered[k][1] <= m.start():
            sentences.append(((at, part), m[0].lower()))
    held: dict[tuple[int, int], set[str]] = {}
    for kind, a, b in spans:
        k = bisect_right(words, b - 1) - 1
        key = number[k] if k >= 0 and words[k] >= a else (bisect_right(ends, a), 0)
        held.setdefault(key, set()).add(entity(kind, text[a:b]))
    free: dict[tuple[int, int], list[str]] = {key: [] for key in held}
    for key, word in sentences:
        if key in free:
            free[key].append(word)
    out = []
    for key, entities in held.items():
        mark = hashlib.blake2b(" ".join(free[key]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((sorted(entities), int.from_bytes(mark, "little", signed=True), sorted({w for w in free[key] if not w.isdigit()})))
    return out


FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "contexts array<struct<entities:array<string>,context:long,terms:array<string>>>"
)


def find(text: Column, sentence_words: int) -> Column:
    """Struct ``FOUND`` of a text column."""

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            spans = base_spans(t)
            n = Counter(k for k, _, _ in spans)
            line = joined(spans)
            near = [{"entities": e, "context": c, "terms": w} for e, c, w in contexts(t, spans, sentence_words)]
            rows.append((*(n[k] for k in KINDS), hashlib.sha256(line.encode()).hexdigest(), line, near))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return scan(text)


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """``(term, df)``: in how many rows of the whole table a term occurs; tasks add up their own rows first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                total.update({w.lower() for w in WORD.findall(text or "")})
            if len(total) > 200_000:
                yield pd.DataFrame({"term": list(total), "n": list(total.values())})
                total = Counter()
        if total:
            yield pd.DataFrame({"term": list(total), "n": list(total.values())})

    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


def row_key(id_col: str, text_col: str) -> Column:
    """The same for repeated rows, else different."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)


def disclosures(found: DataFrame, frequencies: DataFrame, n_docs: int, rules: Rules) -> DataFrame:
    """``(entity, term, disclosure)`` from ``rules.generalise_at`` on, over all documents."""
    near = found.where(F.size("contexts") > 0).select("row", F.explode("contexts").alias("c")).select("row", "c.*")
    near = near.select("row", F.explode("entities").alias("entity"), "context", "terms")
    pairs = near.select("entity", "row", "context", F.explode("terms").alias("term"))
    # rows and contexts are counted after a distinct each, so a frequent entity is spread over its terms and rows
    together = pairs.groupBy("entity", "term", "row").agg(F.count("*").alias("_")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    different = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("_")).groupBy("entity", "term").agg(F.count("*").alias("support"))
    held = near.groupBy("entity", "row").agg(F.count("*").alias("_")).groupBy("entity").agg(F.count("*").alias("df_e"))
    counts = together.join(different.where(F.col("support") >= rules.support), ["entity", "term"]).join(frequencies, "term")
    rows = counts.join(held, "entity")
    total, z = F.lit(float(n_docs)), rules.z
    hits = F.least("both", "support").cast("double")
    cases = F.col("df") - F.col("both") + hits
    share = (hits + z * z / 2 - z * F.sqrt(hits * (cases - hits) / cases + z * z / 4)) / (cases + z * z)
    content = F.log2(total / F.col("df_e"))
    pmi = F.log2(share * total / F.col("df_e"))
    return rows.select("entity", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= rules.generalise_at)


TERM_SPANS = "array<struct<start:long,end:long,remove:boolean>>"


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Occurrences of the terms outside of the base spans."""

    @F.pandas_udf(TERM_SPANS)
    def scan(texts: pd.Series, bases: pd.Series, flagged: pd.Series) -> pd.Series:
        out = []
        for t, line, terms_ in zip(texts, bases, flagged, strict=True):
            wanted = {x["term"]: bool(x["remove"]) for x in terms_}
            taken = [tuple(map(int, x.split(":")[1:])) for x in line.split(",") if x]
            out.append([
                {"start": m.start(), "end": m.end(), "remove": wanted[w]}
                for m in WORD.finditer(t)
                if (w := m[0].lower()) in wanted and all(m.end() <= a or m.start() >= b for a, b in taken)
            ])
        return pd.Series(out)

    return scan(text, base, terms)


def _words(text: Column) -> Column:
    """The distinct words of a text."""

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.lower() for w in WORD.findall(t)}) for t in texts], dtype=object)

    return scan(text)


def revealing_terms(holders: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(row, term, disclosure)``: the flagged terms that a row has itself, by the entity they tell the most of.

    Rows meet terms by the words they have, so an entity's terms are never dealt to all of its rows.
    """
    words = holders.select("row", F.explode(_words(F.col("held"))).alias("term")).join(flagged.select("term").distinct(), "term", "left_semi")
    entities = holders.select("row", F.explode(F.array_distinct(F.flatten("contexts.entities"))).alias("entity"))
    return words.join(entities, "row").join(flagged, ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): ``rows`` has per document its id, ``row`` key, counts, ``base`` spans; ``terms`` has
    ``(row, spans)`` for the rows in which terms reveal an entity."""
    rules = rules or Rules()
    marked = docs.select(F.col(id_col), F.col(text_col).alias("_t"), row_key(id_col, text_col).alias("row"), find(F.col(text_col), rules.sentence_words).alias("f"))
    found = written(marked.select(id_col, "row", "f.*", F.when(F.size("f.contexts") > 0, F.col("_t")).alias("held")), "pii")
    flagged = written(disclosures(found, document_frequencies(docs, text_col), docs.count(), rules), "disclosures")
    holders = found.where("held IS NOT NULL").dropDuplicates(["row"])
    told = revealing_terms(holders, flagged).groupBy("row")
    told = told.agg(F.collect_list(F.struct("term", (F.col("disclosure") >= rules.remove_at).alias("remove"))).alias("terms"))
    spans = holders.select("row", "held", "base").join(told, "row").select("row", _term_spans(F.col("held"), F.col("base"), F.col("terms")).alias("spans"))
    return found.drop("contexts", "held"), spans.where(F.size("spans") > 0)


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans and term spans as one comma-joined string, by start, then kind."""

    @F.pandas_udf("string")
    def merge(bases: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for line, spans in zip(bases, more, strict=True):
            if spans is None or not len(spans):
                out.append(line)
                continue
            rows = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in line.split(",") if x)]
            rows += [(TERM, int(x["start"]), int(x["end"])) for x in spans]
            out.append(joined(sorted(rows, key=lambda x: (x[1], ORDER[x[0]]))))
        return pd.Series(out, dtype=object)

    return merge(base, terms)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per document: id, counts of the base kinds, ``base_sha256`` and all ``spans``."""
    rows, terms = find_pii(docs, id_col, text_col, rules)
    return rows.join(terms, "row", "left").select(
        id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", all_spans(F.col("base"), F.col("spans")).alias("spans")
    )


def sanitised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced; of overlapping spans the union is replaced by the first one's mask."""
    out, done = [], 0
    for a, b, mask in sorted(spans):
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """``docs`` with personal data masked, revealing terms generalised to ``[TERM]`` or removed.

    Null texts stay null; the columns are those of ``docs``.
    """
    terms = find_pii(docs, id_col, text_col, rules)[1]

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for t, extra in zip(texts, more, strict=True):
            if t is None:
                out.append(None)
                continue
            spans = [(a, b, MASKS[k]) for k, a, b in base_spans(t)]
            spans += [(int(x["start"]), int(x["end"]), "" if x["remove"] else "[TERM]") for x in (extra if extra is not None else [])]
            out.append(sanitised(t, spans) if spans else t)
        return pd.Series(out, dtype=object)

    row, spans = spare(docs, "_row"), spare(docs, "_spans")
    both = docs.withColumn(row, row_key(id_col, text_col)).join(terms.select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left")
    return both.withColumn(text_col, rewrite(F.col(text_col), F.col(spans))).select(*docs.columns)
