"""Column expressions over vectors, texts and bytes. All run in the JVM; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = ("the", "and", "with", "for", "are", "was", "this", "that")
_OFFSET_HIGH, _OFFSET_LOW = 3421674724, 2216829733  # the 64-bit FNV offset basis in two 32-bit limbs
_MASK = 0xFFFFFFFF


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """0 where either vector has no length. Norms may be given if they are known."""
    na, nb = (l2_norm(a) if norm_a is None else _col(norm_a)), (l2_norm(b) if norm_b is None else _col(norm_b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def concepts(text) -> Column:
    """The text's concepts, first occurrence first: space-separated tokens' ASCII letters in lower case, of three or more, without stop words."""
    tokens = F.split(F.lower(F.regexp_replace(_col(text), "[^A-Za-z ]", "")), " ")  # one pattern for the whole text
    return F.array_distinct(F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def _symbols(content: Column) -> Column:
    """The bytes as one character each, in time proportional to their number."""
    return F.filter(F.split(F.decode(content, "ISO-8859-1"), ""), lambda c: c != "")


def _codes(content: Column) -> Column:
    """The bytes as numbers."""
    return F.transform(_symbols(content), lambda c: F.ascii(c).cast("long"))


def fnv1a64(text) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes as a signed long; in two limbs, so that nothing overflows."""
    codes = _codes(F.encode(_col(text), "UTF-8"))
    return F.aggregate(codes, _fnv_start(), lambda s, b: _fnv_step(s["hi"], s["lo"].bitwiseXOR(b)), _joined)


def _fnv_start() -> Column:
    return F.struct(F.lit(_OFFSET_HIGH).cast("long").alias("hi"), F.lit(_OFFSET_LOW).cast("long").alias("lo"))


def _fnv_step(hi: Column, lo: Column) -> Column:
    """The limbs' product with the prime 2^40 + 435."""
    product = lo * F.lit(435)
    high = hi * F.lit(435) + F.shiftright(product, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
    return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), product.bitwiseAND(F.lit(_MASK)).alias("lo"))


def _joined(s: Column) -> Column:
    return F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"])


def _taking(c: Column):
    hi, lo = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_MASK))
    return lambda _, x: _fnv_step(x["hi"].bitwiseXOR(hi), x["lo"].bitwiseXOR(lo))


def components_hash(*components) -> Column:
    """One 64-bit hash of several longs, each taken in as a whole: the key of a cached result, or a query's fingerprint."""
    s = _fnv_start()
    for c in components:
        c = _col(c).cast("long")
        # a one-element fold names the limbs, so that the expression grows with the components and not with their powers
        s = F.aggregate(F.array(s), s, _taking(c))
    return _joined(s)


def concept_id(text) -> Column:
    """A content-addressed id with the top bit set, so negative as a long."""
    return fnv1a64(text).bitwiseOR(F.lit(-(1 << 63)))


def is_concept(node_id) -> Column:
    return _col(node_id) < 0


def unsigned(value) -> Column:
    """A long's bits read as an unsigned number."""
    v = _col(value).cast("decimal(20,0)")
    return F.when(v < 0, v + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(v).cast("decimal(20,0)")


def byte_prefix(text, size: int) -> Column:
    """At most ``size`` bytes of the text's UTF-8 (may end inside a character)."""
    return F.substring(F.encode(_col(text), "UTF-8"), 1, size)


def safe_ratio(a, b) -> Column:
    return F.when(_col(b) == 0, 0.0).otherwise(_col(a).cast("double") / F.when(_col(b) == 0, None).otherwise(_col(b)))


def byte_entropy(text) -> Column:
    """Shannon entropy in bits of a text's bytes: a histogram per row, without explode."""
    content = F.encode(_col(text), "UTF-8")
    n = F.octet_length(content)
    counts = F.transform(F.regexp_extract_all(F.array_join(F.array_sort(_symbols(content)), ""), F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda r: F.length(r))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda s, c: s - (c / n) * F.log2(c / n)))


def estimated_ratio(text) -> Column:
    return F.lit(8.0) / F.greatest(F.lit(1.0), byte_entropy(text))


def should_compress(text, min_size: int, min_ratio: float) -> Column:
    return (F.octet_length(_col(text)) >= min_size) & (estimated_ratio(text) >= min_ratio)


def hash_embed(text, size: int = 128) -> Column:
    """A deterministic unit vector of the text: seeded hashes in [-1, 1), normalised."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.xxhash64(_col(text), i).cast("double") / F.lit(float(1 << 63)))
    norm = l2_norm(raw)
    return F.transform(raw, lambda x: (x / norm).cast("float"))


def djb2(text) -> Column:
    """hash * 33 + byte over the UTF-8 bytes, modulo 2^64, as a signed long; in two limbs, so that nothing overflows."""

    def step(s, b):
        low = s["lo"] * F.lit(33) + b
        return F.struct((s["hi"] * F.lit(33) + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK)).alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"))

    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))
    return F.aggregate(_codes(F.encode(_col(text), "UTF-8")), start, step, _joined)


def text_embed(text, size: int = 128) -> Column:
    """A deterministic unit vector of the text's features: at each place 0.3 of the byte there, 0.2 of the length in thousands and 0.5 of
    a number in [-1, 1) that is seeded by the text's hash, within -1 and 1, then normalised. Null for null.

    The numbers are seeded hashes here and not a generator's, so vectors compare among themselves only.
    """
    content = F.encode(_col(text), "UTF-8")
    own = F.array(F.struct(djb2(text).alias("seed"), _codes(F.substring(content, 1, size)).alias("b"), (F.octet_length(content) / 1000.0).alias("n")))

    def place(x, i):
        byte = F.coalesce(F.get(x["b"], i) / 255.0, F.lit(0.0))
        noise = F.xxhash64(x["seed"], i).cast("double") / F.lit(float(1 << 63))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), byte * 0.3 + x["n"] * 0.2 + noise * 0.5))

    places = F.sequence(F.lit(0), F.lit(size - 1))
    raw = F.aggregate(own, F.expr("cast(array() as array<double>)"), lambda _, x: F.transform(places, lambda i: place(x, i)))
    unit = F.aggregate(F.array(raw), F.expr("cast(array() as array<float>)"), lambda _, r: F.transform(r, lambda v: (v / l2_norm(r)).cast("float")))
    return F.when(_col(text).isNotNull(), unit)


def code_of(name, codes: dict[str, int], default: int | None = None) -> Column:
    """The code of a name; unknown names get the default, or raise if there is none."""
    out = None
    for n, code in codes.items():
        out = (F.when if out is None else out.when)(_col(name) == n, F.lit(code).cast("short"))
    return out.otherwise(F.lit(default).cast("short") if default is not None else F.raise_error(F.concat(F.lit("unknown name "), _col(name))).cast("short"))


def register(spark) -> None:
    """SQL functions of the same names, as temporary SQL functions over built-ins."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION concepts(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter(split(lower(regexp_replace(t, '[^A-Za-z ]', '')), ' '), w -> length(w) >= 3 AND NOT array_contains(array('the', 'and', 'with', 'for', 'are', 'was', 'this', 'that'), w)))")


def label_text(label) -> Column:
    """A fixed-width label up to its first NUL."""
    return F.substring_index(_col(label), "\0", 1)


def checksum(content) -> Column:
    """CRC32 of the bytes."""
    return F.crc32(_col(content).cast("binary"))


def runs(text) -> Column:
    """Run-length coding: array<struct<n, c>> of a text's runs of equal characters."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda r: F.struct(F.length(r).alias("n"), F.substring(r, 1, 1).alias("c")))


def from_runs(coded) -> Column:
    return F.array_join(F.transform(_col(coded), lambda r: F.repeat(r["c"], r["n"])), "")
