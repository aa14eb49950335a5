"""Personal data in texts, by DataFrame functions alone (operator 10).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for bank
accounts), and words nearby adjust the score. Positions come from ``split`` and
``regexp_extract_all`` with one pattern: what lies between the matches and the matches add up.
A row's work depends on its own text only; there is no shuffle.

The patterns are linear: possessive groups don't recurse, and a run is tried from its start
only, since a later start in it fails for the same reason. Arrays grow in blocks of ``BLOCK``
spans, so that a text with very many of them isn't copied once for each.

Null text is empty and has no spans. Offsets count code points, ends are exclusive. Rows that
repeat are each answered, alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that a text must pass before the pattern is tried.
    needs: str
    #: SQL over m (the match): is it one?
    valid: str
    score: float
    #: Words whose presence within 48 characters raises the score.
    context: str
    #: Least score to be reported; 0: always.
    least: float = 0.0


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_DOUBLED = "'0123456789', '0246813579'"
_LUHN = f"""pmod(aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + cast(
    if(i % 2 = 0, translate(substring({_DIGITS}, -i, 1), {_DOUBLED}), substring({_DIGITS}, -i, 1)) as int)), 10) = 0"""
_PART = "regexp_replace(p, '^0+(?=[0-9])', '')"
_IBAN = "replace(m, ' ', '')"
_MOD97 = f"""aggregate(split(concat(substring({_IBAN}, 5, 30), substring({_IBAN}, 1, 4)), ''), 0, (a, c) ->
    if(c = '', a, if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"""

BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", "true", 0.9, "mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "text rlike '[0-9][.][0-9]'", f"forall(split(m, '[.]'), p -> if(length({_PART}) <= 3, cast({_PART} as int) <= 255, false))", 0.6, "ip|host|server|address|client|login"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++", "text rlike '[0-9][ -]?[0-9]'", f"if(length({_DIGITS}) between 13 and 19, {_LUHN}, false)", 0.7, "card|visa|credit|debit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", f"length({_DIGITS}) between 9 and 15", 0.7, "tel|phone|call|fax|mobil|cell"),
)
EXTRA = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "text rlike '[A-Z][A-Z][0-9][0-9]'", f"if(length({_IBAN}) between 15 and 34, {_MOD97}, false)", 0.8, "iban|bank|account|konto|cuenta|compte", 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]'", "not (m like '000%' or m like '666%' or m like '9%' or substring(m, 5, 2) = '00' or substring(m, 8, 4) = '0000')", 0.4, "ssn|social security", 0.5),
)
#: Column for spans where every column of the input stays.
_SPANS = "lodestar_spans"
_SPAN = "struct<kind:string,s:int,e:int,score:double>"
#: Spans that are gathered at once.
BLOCK = 128


def _spans(kind: Kind) -> Column:
    pattern = kind.pattern.replace("\\", "\\\\")
    hits = f"if({kind.needs}, regexp_extract_all(text, '{pattern}', 0), cast(array() as array<string>))"
    one = f"""transform(filter(array(z.m), m -> {kind.valid}), m -> cast(named_struct(
        'kind', '{kind.name}', 's', acc.at + length(z.before), 'e', acc.at + length(z.before) + length(z.m),
        'score', least(1.0D, {kind.score}D + if(lower(concat(right(z.before, 48), ' ', left(z.after, 48))) rlike '\\\\b({kind.context})', 0.2D, 0.0D))) as {_SPAN}))"""
    block = f"""aggregate(
        transform(slice(hits, b * {BLOCK} + 1, {BLOCK}), (m, i) -> named_struct('m', m, 'before', parts[b * {BLOCK} + i], 'after', parts[b * {BLOCK} + i + 1])),
        named_struct('at', all.at, 'out', cast(array() as array<{_SPAN}>)),
        (acc, z) -> named_struct('at', acc.at + length(z.before) + length(z.m), 'out', concat(acc.out, {one})))"""
    found = f"""if(size(hits) = 0, cast(array() as array<{_SPAN}>), aggregate(
        sequence(0, cast((size(hits) - 1) div {BLOCK} as int)),
        named_struct('at', 0, 'out', cast(array() as array<array<{_SPAN}>>)),
        (all, b) -> transform(array({block}), r -> named_struct('at', r.at, 'out', concat(all.out, array(r.out))))[0],
        all -> filter(flatten(all.out), x -> x.score >= {kind.least}D)))"""
    # the arrays are bound by lambdas, so that each is made once for a row
    parts = f"if(size(hits) = 0, cast(array() as array<string>), split(text, '{pattern}', -1))"
    return F.expr(f"transform(array({hits}), hits -> transform(array({parts}), parts -> {found})[0])[0]")


def _found(docs: DataFrame, name: str) -> DataFrame:
    """The columns of ``docs`` but ``name``, and that: array of (kind, s, e, score), by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("row"), text.alias("text"))
    for kind in (*BASE, *EXTRA):
        rows = rows.withColumn(kind.name, _spans(kind))
    return rows.select("row.*", F.concat(*[F.col(k.name) for k in (*BASE, *EXTRA)]).alias(name))


def find_pii(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and pii: array of (kind, s, e, score); an own column of that name is replaced."""
    return _found(docs, "pii")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans and scores."""
    found = find_pii(docs.select("doc_id", "text"))
    base = ", ".join(f"'{k.name}'" for k in BASE)
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k.name}')) as bigint)").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined(f"filter(pii, x -> x.kind in ({base}))")), 256).alias("base_sha256"), F.expr(_joined("pii")).alias("spans"), F.expr("array_join(transform(pii, x -> cast(round(x.score, 2) as string)), ',')").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    found = _found(docs, _SPANS)
    sorted_spans = f"array_sort({_SPANS}, (a, b) -> case when a.s < b.s then -1 when a.s > b.s then 1 when a.e > b.e then -1 when a.e < b.e then 1 else 0 end)"
    # a block's part of the text is cut out first: what is before it isn't counted again for each span
    block = f"""aggregate(some, named_struct('at', all.at, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.s < acc.at, named_struct('at', greatest(acc.at, x.e), 'out', acc.out),
            named_struct('at', x.e, 'out', concat(acc.out, array(substring(part, acc.at - all.at + 1, x.s - acc.at), concat('<', x.kind, '>'))))))"""
    cut = f"""transform(array({sorted_spans}), spans -> aggregate(
        sequence(0, cast((size(spans) - 1) div {BLOCK} as int)), named_struct('at', 0, 'out', cast(array() as array<string>)),
        (all, b) -> transform(array(slice(spans, b * {BLOCK} + 1, {BLOCK})), some ->
            transform(array(substring(text, all.at + 1, greatest(0, array_max(transform(some, x -> x.e)) - all.at))), part ->
                transform(array({block}), r -> named_struct('at', r.at, 'out', concat(all.out, array(array_join(r.out, '')))))[0])[0])[0],
        all -> array_join(concat(all.out, array(substring(text, all.at + 1, length(text)))), '')))[0]"""
    text = F.when(F.size(_SPANS) > 0, F.expr(cut)).otherwise(F.col("text"))
    return found.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
