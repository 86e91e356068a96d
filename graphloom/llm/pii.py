"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are the leftmost matches of fixed patterns that pass a check of digits, ranges or Luhn's sum.
Wider patterns propose more candidates: addresses written with "at" and "dot", phone numbers without a plus, card numbers
with other separators. Labelers vote for, against or not at all on every candidate:

    strict    a base pattern with its check            gazetteer  known top-level domains, issuer digits, country codes, special networks
    check     digits, ranges or Luhn's sum hold        context    words before it that go with, or against, its kind
    shape     it stands by itself, or inside a longer run

Expectation-maximisation over the counts of vote patterns (a table whose size doesn't grow with the corpus) estimates how
reliable each labeler is; the posteriors then train a logistic span classifier on votes, kind and length. A candidate that
overlaps no base span is added if the classifier gives it at least ``ACCEPT``; base spans always stay.

Patterns run in linear time on any text: runs are taken possessively or begin where no run goes on, and no pattern repeats a
group without bound. Counts, not texts, reach the driver.

Nulls and odd input: a null text counts as empty: no spans; null and repeated doc_ids and repeated rows keep a row each; an empty
table gives an empty result (the classifier then keeps its prior); further columns stay in ``find`` and ``redact``, of which the
result columns replace those of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The probability from which an added candidate counts; rounds of expectation-maximisation; of the classifier's training.
ACCEPT, EM_ROUNDS, FIT_ROUNDS = 0.9, 50, 300
LABELERS = ("strict", "checked", "gazetteer", "context", "shape")

_L, _D = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Where a match may begin: not inside a run of these, unless the last match ended there.
BASE = {
    "email": rf"(?:\G|(?<!{_L})){_L}++@{_D}++\.{_D}[A-Za-z0-9.-]*?(?!{_D}|\.{_D})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, if it has 14 to 19 digits; longer and shorter runs fail as a whole
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]? ?(?:at|AT|@) ?[\])}]? ?[A-Za-z0-9-]{1,63}+ ?[\[({]? ?(?:dot|DOT|\.) ?[\])}]? ?(?:com|org|net|edu|gov|info|de|fr|es|uk|io)(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9.])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
}
#: A wider pattern is tried only where its anchor is in the text.
ANCHOR = {"email": r"(?i)\b(?:at|@)\b ?[\])}]?|@", "ip": r"\[\.\]", "card": r"[0-9]{4}[./_][0-9]{4}[./_]", "phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"}
_TLD = "com|org|net|edu|gov|mil|info|biz|int|io|co|de|fr|es|uk|eu|us|ca|ch|at|it|nl|be|pt|mx|ar|br|jp|cn|in|au"
CONTEXT_FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt|address)\W*(?:\w+\W+){0,3}$",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from|client|adresse|dirección)\W*(?:\w+\W+){0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay|carte|tarjeta|karte)\W*(?:\w+\W+){0,3}$",
    "phone": r"(?i)(?:call|phone|tel|mobile|cell|fax|téléphone|teléfono|telefon|dial|ring)\W*(?:\w+\W+){0,3}$",
}
CONTEXT_AGAINST = r"(?i)\b(?:version|v|isbn|issn|order|invoice|section|chapter|figure|table|page|serial|sku|part|model|release)\W*$"


def _prefix(lengths: str) -> str:
    """SQL for the sums before each element of an array<int>, in blocks so that long arrays don't cost the square of their length."""
    run = lambda items, start: f"slice(aggregate({items}, array({start}), (s, x) -> array_append(s, element_at(s, -1) + x)), 1, size({items}))"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div 64), b -> slice({lengths}, cast(b * 64 + 1 as int), 64))"
    sums = f"transform({blocks}, b -> aggregate(b, 0, (s, x) -> s + x))"
    return f"flatten(zip_with({blocks}, {run(sums, '0')}, (b, before) -> {run('b', 'before')}))"


def _spans(df: DataFrame, text: str, kind: str, pattern: str, out: str, anchor: str | None = None) -> DataFrame:
    """df with ``out``: array<struct<kind, s, e, t>>, the matches in code points, end exclusive."""
    may = F.contains(F.col(text), F.lit("@")) if out == "b_email" else F.col(text).rlike(anchor) if anchor else F.lit(True)
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    # the gaps between the matches give their places
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))))
    df = df.withColumn("_l", F.when(F.size("_m") > 0, F.expr("zip_with(slice(_g, 1, size(_m)), transform(_m, m -> length(m)), (g, m) -> g + m)")))
    df = df.withColumn(out, F.when(F.size("_m") > 0, F.expr(f"zip_with(_m, zip_with({_prefix('_l')}, slice(_g, 1, size(_m)), (p, g) -> p + g), (m, p) -> named_struct('kind', '{kind}', 's', p, 'e', p + length(m), 't', m))")))
    empty = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,t:string>>)")
    return df.withColumn(out, F.coalesce(F.col(out), empty)).drop("_m", "_g", "_l")


_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN (length(d) - i) % 2 = 0 THEN cast(substr(d, i, 1) as int) "
    "ELSE cast((2 * cast(substr(d, i, 1) as int)) div 10 as int) + (2 * cast(substr(d, i, 1) as int)) % 10 END) % 10 = 0"
)


def _check(kind: str) -> str:
    """SQL for whether candidate x passes its kind's check."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return r"forall(split(replace(replace(x.t, '[', ''), ']', ''), '[.]'), p -> length(ltrim('0', p)) < 3 OR length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255')"
    if kind == "card":
        return f"length({_DIGITS}) BETWEEN 14 AND 19 AND exists(array({_DIGITS}), d -> {_LUHN})"
    return f"length({_DIGITS}) BETWEEN 10 AND 15"


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def _gazetteer(kind: str) -> str:
    if kind == "email":
        return _vote(f"x.t RLIKE '(?i)(?:[.]|dot ?|[)}}\\\\]] ?)(?:{_TLD})$'", "x.t RLIKE '(?i)[.](?:png|jpg|gif|js|css|html?|pdf|zip|exe)$'")
    if kind == "ip":  # special networks: this one, loopback, multicast and above
        return _vote("x.t RLIKE '^(?:1?[1-9]|[2-9][0-9]|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])[.\\\\[]'", "x.t RLIKE '^(?:0+|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.\\\\[]'")
    if kind == "card":
        return _vote(f"{_DIGITS} RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|30|36|38|62)'", f"{_DIGITS} RLIKE '^[0789]|^(.)\\\\1+$'")
    return _vote(f"x.t RLIKE '^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' OR length({_DIGITS}) = 10 AND NOT {_DIGITS} RLIKE '^[01]'", f"{_DIGITS} RLIKE '^(?:0{{3}}|(.)\\\\1+$)'")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kept, own, base, more): a row's other columns as a struct with fields by place, its text, and candidate spans with their votes."""
    kept = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text))
    df = docs.select(kept.alias("kept"), F.col(f"`{text}`").alias("own")).withColumn("_t", F.coalesce(F.col("own").cast("string"), F.lit("")))
    for kind in KINDS:
        df = _spans(df, "_t", kind, BASE[kind], f"b_{kind}")
        df = df.withColumn(f"b_{kind}", F.expr(f"filter(b_{kind}, x -> {_check(kind)})"))
        df = _spans(df, "_t", kind, WIDER[kind], f"w_{kind}", ANCHOR[kind])
    df = df.withColumn("_b", F.concat(*(F.col(f"b_{k}") for k in KINDS)))
    # of the wider candidates those that overlap no base span
    wider = F.concat(*(F.col(f"w_{k}") for k in KINDS))
    df = df.withColumn("_w", wider).withColumn("_w", F.when(F.size("_w") > 0, F.expr("filter(_w, x -> NOT exists(_b, y -> x.s < y.e AND y.s < x.e))")).otherwise(F.col("_w")))
    by = lambda f: "CASE " + " ".join(f"WHEN x.kind = '{k}' THEN {f(k)}" for k in KINDS) + " END"
    left = "substr(_t, greatest(1, x.s - 47), least(48, x.s))"
    near = "concat(CASE WHEN x.s > 0 THEN substr(_t, x.s, 1) ELSE ' ' END, coalesce(substr(_t, x.e + 1, 1), ''))"
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    votes = [
        ("kind", "x.kind"), ("s", "x.s"), ("e", "x.e"), ("base", "{base}"),
        ("strict", "{strict}"),
        ("checked", by(lambda k: _vote(_check(k), "true"))),
        ("gazetteer", by(_gazetteer)),
        ("context", by(lambda k: _vote(f"{left} RLIKE {quoted(CONTEXT_FOR[k])}", f"{left} RLIKE {quoted(CONTEXT_AGAINST)}"))),
        ("shape", _vote(f"{near} RLIKE '^[^A-Za-z0-9][^A-Za-z0-9]?$'", "true")),
        ("long", "CASE WHEN x.e - x.s < 12 THEN 0 WHEN x.e - x.s < 20 THEN 1 ELSE 2 END"),
    ]
    struct = lambda base: "named_struct(" + ", ".join(f"'{n}', {v.format(base=base, strict=1 if base == 'true' else 0) if n in ('base', 'strict') else v}" for n, v in votes) + ")"
    for name, source, base in (("base", "_b", "true"), ("more", "_w", "false")):
        df = df.withColumn(name, F.when(F.size(source) > 0, F.expr(f"transform({source}, x -> {struct(base)})")))
        kind = df.schema[name].dataType.simpleString()
        df = df.withColumn(name, F.coalesce(F.col(name), F.expr(f"cast(array() as {kind})")))
    return df.drop("_t", "_b", "_w", *(f"{p}_{k}" for k in KINDS for p in "bw"))


class Reliabilities:
    """Expectation-maximisation over counts of vote patterns: P(vote | span is personal or not), for each labeler, and a share for each kind."""

    def __init__(self, rows: list[dict]):
        # priors, as so many seen votes: labelers are right more often than wrong; half of a kind's candidates are personal
        self.rows, self.prior = rows, {"for": {1: 6.0, 0: 3.0, -1: 1.0}, "against": {1: 1.0, 0: 3.0, -1: 6.0}}
        self.share = dict.fromkeys(KINDS, 0.5)
        self.votes = {n: {c: {v: p / 10 for v, p in prior.items()} for c, prior in self.prior.items()} for n in LABELERS}
        for _ in range(EM_ROUNDS):
            self._round()

    def posterior(self, row: dict) -> float:
        a, b = math.log(self.share[row["kind"]]), math.log(1 - self.share[row["kind"]])
        for n in LABELERS:
            a += math.log(self.votes[n]["for"][row[n]])
            b += math.log(self.votes[n]["against"][row[n]])
        return 1 / (1 + math.exp(min(700, b - a)))

    def _round(self) -> None:
        share = {k: [1.0, 2.0] for k in KINDS}
        votes = {n: {c: dict(prior) for c, prior in self.prior.items()} for n in LABELERS}
        for row in self.rows:
            p = self.posterior(row)
            share[row["kind"]][0] += p * row["n"]
            share[row["kind"]][1] += row["n"]
            for n in LABELERS:
                votes[n]["for"][row[n]] += p * row["n"]
                votes[n]["against"][row[n]] += (1 - p) * row["n"]
        self.share = {k: a / b for k, (a, b) in share.items()}
        self.votes = {n: {c: {v: x / sum(seen.values()) for v, x in seen.items()} for c, seen in own.items()} for n, own in votes.items()}


def _features(row: dict) -> list[tuple]:
    return [("bias",), ("kind", row["kind"]), ("long", row["long"]), *((n, row[n]) for n in LABELERS)]


def span_classifier(rows: list[dict], posterior) -> dict[tuple, float]:
    """Weights of a logistic classifier of spans, fitted to posteriors by gradient steps over the vote patterns (each weighed by the log of its count)."""
    weights: dict[tuple, float] = {}
    data = [(_features(r), posterior(r), 1 + math.log(r["n"])) for r in rows]
    total = sum(w for _, _, w in data) or 1.0
    for _ in range(FIT_ROUNDS):
        step: dict[tuple, float] = {}
        for features, y, w in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in features)))))
            for f in features:
                step[f] = step.get(f, 0.0) + w * (y - p)
        for f, g in step.items():
            weights[f] = weights.get(f, 0.0) * 0.999 + 2.0 * g / total
    return weights


def _score(weights: dict[tuple, float]) -> str:
    """SQL for the classifier's linear score of candidate x."""
    parts = [f"{weights.get(('bias',), 0.0)!r}D"]
    for name in ("kind", "long", *LABELERS):
        own = {f[1]: w for f, w in weights.items() if f[0] == name}
        if own:
            parts.append("(CASE " + " ".join(f"WHEN x.{name} = {v!r} THEN {w!r}D" for v, w in sorted(own.items())) + " ELSE 0D END)")
    return " + ".join(parts)


def _found(docs: DataFrame, text: str, accept: float) -> tuple[DataFrame, dict[str, Column]]:
    """(kept, own, base, spans) of every row, and where the columns of docs are in it."""
    voted = written(candidates(docs, text), "pii")
    shape = ("kind", "long", *LABELERS)
    seen = voted.select(F.explode(F.concat("base", "more")).alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in shape)).agg(F.count("*").alias("n"))
    rows = sorted((r.asDict() for r in seen.collect()), key=str)  # at most 4 * 3 ** 6 patterns
    weights = span_classifier(rows, Reliabilities(rows).posterior)
    rank = "CAST(array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind) - 1 AS INT)"
    place = f"x -> named_struct('s', x.s, 'rank', {rank}, 'e', x.e)"
    added = f"filter(more, x -> {_score(weights)} >= {math.log(accept / (1 - accept))!r}D)"
    out = voted.withColumn("spans", F.expr(f"array_sort(transform(concat(base, {added}), {place}))")).withColumn("base", F.expr(f"array_sort(transform(base, {place}))"))
    return out.drop("more"), {c: F.col("own") if c == text else F.col(f"kept.c{k}") for k, c in enumerate(docs.columns)}


def find(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (s, rank, e) with rank the place in KINDS, by start and then kind. Votes are trained on all rows."""
    found, at = _found(docs, text, accept)
    return found.select(*(c.alias(n) for n, c in at.items() if n not in ("base", "spans")), "base", "spans")


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.rank + 1), x.s, x.e)), ',')")


def redact(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs, in their columns, with every span replaced by its kind in angle brackets (overlapping spans by the first's); n_chars, if there, counted again."""
    found, at = _found(docs, text, accept)
    label = "element_at(array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + "), x.rank + 1)"
    cut_ = (
        f"aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> CASE WHEN x.s >= a.at "
        f"THEN named_struct('at', x.e, 'out', concat(a.out, array(substr(own, a.at + 1, x.s - a.at), {label}))) "
        f"ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END, a -> array_join(array_append(a.out, substr(own, a.at + 1)), ''))"
    )
    out = found.withColumn("new", F.when(F.size("spans") > 0, F.expr(cut_)).otherwise(F.col("own")))
    of = {text: F.col("new")} | ({"n_chars": F.when(F.size("spans") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(at["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*(of.get(n, c).alias(n) for n, c in at.items()))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    # as SQL: a lambda's second parameter would be taken for the element's place
    counts = [F.expr(f"size(filter(base, x -> x.rank = {r}))").cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
