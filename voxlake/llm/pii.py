"""Personal data spans with DataFrame functions only.

Patterns propose spans, checksums confirm them (Luhn for cards, modulo 97 for account numbers), and words close by move
the score. A span is (kind, start, end, value, score) with positions in code points, end exclusive.

Where a match stands follows from the texts between matches: split() and regexp_extract_all() walk through the same
leftmost matches, so a match starts after all gaps and matches before it. The patterns are written without nested
backtracking and start only where a run starts, so their time grows with the text's length also for long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, table

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str  # a pattern that is cheap to look for in texts, or a plain character
    pattern: str
    accept: str  # SQL over m, the matched text
    context: str  # words that raise the score if they stand in the 40 code points before
    score: float
    least: float  # spans of a lower score are dropped; 0: always kept


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""(aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN (length({_DIGITS}) - i) % 2 = 0
 THEN CAST(substring({_DIGITS}, i, 1) AS INT) ELSE CAST(substring('0246813579', CAST(substring({_DIGITS}, i, 1) AS INT) + 1, 1) AS INT) END) % 10 = 0)"""
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BARE = "replace(m, ' ', '')"
_MOD97 = f"""(aggregate(split(concat(substring({_BARE}, 5), substring({_BARE}, 1, 4)), ''), 0, (a, c) -> CASE
 WHEN c = '' THEN a WHEN ascii(c) >= 65 THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END) = 1)"""

#: In the order in which spans are listed. The first four are always kept once their checks pass.
KINDS = [
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "mail|contact|write|kontakt|correo|courriel", 0.9, 0.0),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"m rlike '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'", "ip|address|host|server|login|adresse", 0.6, 0.0),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9]){12,}+", f"(length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})", "card|visa|credit|debit|karte|carte|tarjeta|payment", 0.7, 0.0),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", f"(length({_DIGITS}) BETWEEN 9 AND 15)", "phone|call|tel|mobile|fax|telefon", 0.6, 0.0),
    Kind("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", f"(length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97})", "iban|account|bank|konto|compte|cuenta", 0.7, 0.5),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "(substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 1) <> '9' AND substring(m, 5, 2) <> '00' AND substring(m, 8, 4) <> '0000')", "ssn|social|security|taxpayer|tin", 0.3, 0.5),
    Kind("secret", "[0-9A-Za-z_-]{20}", r"(?<![0-9A-Za-z_-])(?:[0-9a-f]{32,128}+|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z_-]{20,}+)(?![0-9A-Za-z_-])", "true", "token|secret|key|password|passwd|bearer|credential", 0.3, 0.5),
]
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _found(kind: Kind) -> Column:
    """Matches of a kind and the lengths of the texts between them; null where the text has none."""
    text = F.col("text")
    maybe = text.contains(kind.needs) if len(kind.needs) == 1 else text.rlike(kind.needs)
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    return F.when(maybe, F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), gaps.alias("g")))


def _spans(kind: Kind) -> Column:
    """Accepted spans of a kind from the column that _found() made."""
    f = f"_{kind.name}"
    starts = f"aggregate(sequence(1, size({f}.m)), named_struct('s', 0, 'v', CAST(array() AS array<int>)), (a, i) -> named_struct('s', a.s + element_at({f}.g, i) + length(element_at({f}.m, i)), 'v', array_append(a.v, a.s + element_at({f}.g, i))), a -> a.v)"
    made = f"CASE WHEN size({f}.m) > 0 THEN zip_with({f}.m, {starts}, (m, s) -> named_struct('m', m, 's', s, 'ok', {kind.accept})) END"
    near = f"substring(text, greatest(x.s - 39, 1), least(40, x.s)) rlike '(?i)(?<![a-z])({kind.context})'"
    full = f"transform(filter({made}, x -> x.ok), x -> named_struct('kind', '{kind.name}', 'start', x.s, 'end', x.s + length(x.m), 'value', x.m, 'score', CASE WHEN {near} THEN {min(1.0, kind.score + 0.3)}D ELSE {kind.score}D END))"
    return F.expr(f"coalesce(filter({full}, x -> x.score >= {kind.least}D), CAST(array() AS {SPAN}))")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and one array of spans for each kind (email, ip, card, phone, iban, ssn, secret), ordered by start.

    Null text counts as empty. Rows are handled one by one: repeated rows and null ids are kept, an empty table gives
    no row, other columns are not read, and nothing is shuffled.
    """
    texts = keyed_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = texts.select("doc_id", "text", *[_found(k).alias(f"_{k.name}") for k in KINDS])
    return found.select("doc_id", "text", *[_spans(k).alias(k.name) for k in KINDS])


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    listed = lambda names: F.array_join(F.transform(F.concat(*names), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(BASE).cast("binary"), 256).alias("base_sha256"), listed([k.name for k in KINDS]).alias("spans"), sum((F.size(k.name) for k in KINDS), F.lit(0)).cast("long").alias("n_found"))
