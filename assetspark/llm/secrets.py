"""Secret scans with a randomness test battery (operator 9).

Everything is DataFrame functions.  The base patterns are found with their code
point offsets by splitting a text at a pattern and adding up what lies between.
The battery then looks at other long tokens: a token's encoding is inferred from
its characters, and three tests compare it with uniform draws from that
encoding's alphabet (chi-squared over eight equal parts of the alphabet, runs
about the alphabet's middle, serial correlation).  Their statistics are added to
one, which random tokens give a chi-squared law of ``FREEDOM`` degrees.  A token
is a finding when

* that sum does not reject that it is random, and
* it is too small for natural words of the token's length: its lower tail under
  the corpus's own word-like tokens, a non-central law whose shift grows with
  the length, is significant after Benjamini-Hochberg control within the token's
  encoding and length class over the whole corpus.

Word-like tokens (letters of one case) are the measure and are no findings.
Texts are scanned once; what is found is written, and the corpus's thresholds
and the verdicts come from that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Longest runs, so the least length in the pattern is the same as a test afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Lower ends of the length classes, false-discovery rate.
LENGTHS, FDR = (20, 24, 32, 48, 80), 0.01
#: Parts of an alphabet in the chi-squared test; degrees of freedom of the three tests together.
PARTS, FREEDOM = 8, 9
#: A random token's sum stays below this with probability 0.99.
RANDOM_LIMIT = 21.666
#: Steps of a tenfold in the table of tail probabilities, and its end; steps of one in the table of words' unevenness.
STEPS, LAST, GRAIN = 4, 120, 100
#: Unevenness of words where a corpus has no word-like token: lower-case letters used evenly.
EVEN_WORDS = 1.1
#: Matches that are added up together; an array that grows by one is copied each time.
CHUNK = 256
#: Code points of a block in which a text is cut to mask spans.
BLOCK = 4096
SPAN = "struct<s:int,e:int,v:string>"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; an expression inside a lambda is computed at each of its calls."""
    return F.get(F.transform(F.array(value), then), 0)


def _folded(count: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array that ``step`` makes of (at, out) and each index below ``count``, CHUNK of them at a time."""
    none = F.array().cast(f"array<{kind}>")

    def chunk(acc: Column, i: Column) -> Column:
        some = F.aggregate(F.sequence(i, F.least(i + (CHUNK - 1), count - 1)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _bound(some, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(CHUNK)), start, chunk, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of a pattern's matches: code points, end exclusive."""

    def fold(found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            s, v = acc["at"] + F.length(F.get(found["parts"], i)), F.get(found["hits"], i)
            e = s + F.length(v)
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), v.alias("v")))).alias("out"))

        return _folded(F.size(found["hits"]), SPAN, step)

    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _bound(F.struct(parts.alias("parts"), hits.alias("hits")), fold)


def _assigned(text: Column) -> Column:
    """Matches of ASSIGN whose value has six characters or more."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return _bound(F.struct(values.alias("values"), _spans(text, ASSIGN).alias("spans")), lambda x: F.filter(x["spans"], lambda _, i: F.length(F.get(x["values"], i)) >= 6))


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` and array columns ``_assign``, ``_access`` and ``_hex``; needs ``_t``."""
    none = F.array().cast(f"array<{SPAN}>")
    t = F.col("_t")
    return docs.withColumns(
        {
            "_assign": F.when((t.contains(":") | t.contains("=")) & t.rlike(ASSIGN), _assigned(t)).otherwise(none),
            "_access": F.when(t.contains("AKIA"), _spans(t, ACCESS)).otherwise(none),
            "_hex": F.when(t.rlike(HEX), _spans(t, HEX)).otherwise(none),
        }
    )


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    x = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) * 0.3989422804014327 * poly


def _battery(token: Column) -> Column:
    """A token's encoding, length, kind and test results as a struct."""
    v = token["v"]
    enc = F.when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(v.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    own = F.when(enc == "hex", F.lower(v)).otherwise(F.translate(v, "-_", "+/"))
    letters = F.when(enc == "hex", F.lit(ALPHABETS["hex"])).when(enc == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))
    return F.struct(
        token["s"].alias("s"),
        token["e"].alias("e"),
        enc.alias("enc"),
        F.length(letters).alias("a"),
        F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: F.instr(letters, c) - 1).alias("x"),
        v.rlike("^[A-Za-z]?[a-z]+$|^[A-Z]+$").alias("word"),
    )


def _measured(x: Column) -> Column:
    """What the tests need of a token's symbols; each step below binds the one before."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda b: F.size(F.filter(x["x"], lambda k: F.floor(k * PARTS / x["a"]) == b)))
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), x["word"].alias("word"), x["x"].alias("x"),
        F.size(x["x"]).alias("n"),
        F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c).alias("squares"),
        F.transform(x["x"], lambda k: k * 2 >= x["a"]).alias("bits"),
        (F.aggregate(x["x"], F.lit(0.0), lambda s, k: s + k) / F.size(x["x"])).alias("mean"),
    )


def _moments(x: Column) -> Column:
    n, bits, off = x["n"], x["bits"], lambda i: F.get(x["x"], i) - x["mean"]
    later = F.sequence(F.lit(1), n - 1)
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), x["word"].alias("word"), n.alias("n"),
        (x["squares"] * PARTS / n - n).alias("chi"),
        F.size(F.filter(bits, lambda b: b)).cast("double").alias("ones"),
        (1 + F.size(F.filter(later, lambda i: F.get(bits, i) != F.get(bits, i - 1)))).alias("runs"),
        F.aggregate(x["x"], F.lit(0.0), lambda s, k: s + (k - x["mean"]) * (k - x["mean"])).alias("var"),
        F.aggregate(later, F.lit(0.0), lambda s, i: s + off(i) * off(i - 1)).alias("lag"),
        (2 * F.size(F.filter(bits, lambda b: b)) * (n - F.size(F.filter(bits, lambda b: b))) / n).alias("mid"),
    )


def _together(x: Column) -> Column:
    """The sum of the three tests' statistics."""
    n = x["n"]
    spread = F.sqrt(F.greatest(x["mid"] * (x["mid"] - 1) / (n - 1), F.lit(0.0)))
    z_runs = F.when(spread > 0, F.abs(x["runs"] - x["mid"] - 1) / spread).otherwise(F.sqrt(n))
    z_lag = F.when(x["var"] > 0, F.abs(x["lag"] / x["var"]) * F.sqrt(n)).otherwise(F.sqrt(n))
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), x["word"].alias("word"), n.alias("n"),
        F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda k: k <= n)).alias("cls"),
        (x["chi"] + z_runs * z_runs + z_lag * z_lag).alias("sum"),
    )


def with_tokens(based: DataFrame) -> DataFrame:
    """Adds ``_tokens``: the test results of tokens that touch no base span."""
    base = F.concat("_assign", "_access", "_hex")
    none = F.array().cast(f"array<{SPAN}>")
    t = F.col("_t")
    long_ = F.when(t.rlike(TOKEN), F.filter(_spans(t, TOKEN), lambda x: ~F.exists(F.col("_base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))).otherwise(none)
    return (
        based.withColumn("_base", base)
        .withColumn("_long", long_)
        .withColumn("_encoded", F.transform("_long", _battery))
        .withColumn("_tokens", F.transform(F.transform(F.transform("_encoded", _measured), _moments), _together))
        .drop("_base", "_long", "_encoded")
    )


def _stepped(tokens: str, uneven: float) -> Column:
    """Array of the tokens that are no words with ``step``: how many steps of 1 / STEPS
    tenfolds the lower tail of their sum lies below one, were they words."""

    def score(x: Column) -> Column:
        shift = x["n"] * F.lit(uneven)
        z = (FREEDOM + shift - x["sum"]) / F.sqrt(2 * (FREEDOM + 2 * shift))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"), x["cls"].alias("cls"), x["sum"].alias("sum"), F.greatest(z, F.lit(0.0)).alias("z"))

    def tail(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("s", "e", "enc", "cls", "sum")], _tail(x["z"]).alias("p"))

    def step(x: Column) -> Column:
        down = F.least(F.floor(-F.log10(F.greatest(x["p"], F.lit(1e-300))) * STEPS), F.lit(LAST)).cast("int")
        return F.struct(*[x[c].alias(c) for c in ("s", "e", "enc", "cls", "sum")], down.alias("step"))

    return F.transform(F.transform(F.transform(F.filter(tokens, lambda x: ~x["word"]), score), tail), step)


def _random(uneven: float, cuts: dict[tuple[str, int], int]) -> Column:
    """The findings among ``_tokens``."""

    def found(x: Column) -> Column:
        least = F.lit(None).cast("int")
        if cuts:
            table_ = F.create_map(*[F.lit(v) for (e, c), s in sorted(cuts.items()) for v in (f"{e}{c}", s)])
            least = F.element_at(table_, F.concat(x["enc"], x["cls"].cast("string")))
        return (x["sum"] <= RANDOM_LIMIT) & F.coalesce(x["step"] >= least, F.lit(False))

    return F.filter(_stepped("_tokens", uneven), found)


def calibrate(tokens: DataFrame) -> tuple[float, dict[tuple[str, int], int]]:
    """Unevenness of the corpus's words (its median), and each class's Benjamini-Hochberg step.

    Two counts over all tokens, in whole numbers, so the order of rows changes
    nothing; what comes to the driver is at most a row for each grain of
    unevenness, and for each encoding, length class and step.
    """
    each = tokens.select(F.explode("_tokens").alias("x"))
    grains = each.where("x.word").groupBy(F.floor((F.col("x.sum") - FREEDOM) / F.col("x.n") * GRAIN).alias("k")).count().collect()
    half, uneven = sum(r["count"] for r in grains) / 2, EVEN_WORDS
    for k, n in sorted((r["k"], r["count"]) for r in grains):
        half -= n
        if half <= 0:
            uneven = max(0.5, k / GRAIN)
            break
    table_ = (
        tokens.select(F.explode(_stepped("_tokens", uneven)).alias("x"))
        .groupBy(F.col("x.enc").alias("enc"), F.col("x.cls").alias("cls"), F.col("x.step").alias("step")).count().collect()
    )
    cuts: dict[tuple[str, int], int] = {}
    for key in {(r["enc"], r["cls"]) for r in table_}:
        rows = sorted(((r["step"], r["count"]) for r in table_ if (r["enc"], r["cls"]) == key), reverse=True)
        total, above = sum(n for _, n in rows), 0
        for step, n in rows:
            above += n
            if 10 ** (-step / STEPS) <= FDR * above / total:
                cuts[key] = step
    return uneven, cuts


def _scanned(docs: DataFrame, row: Column, text_col: str) -> DataFrame:
    """(_row, _assign, _access, _hex, _random) of each row, from one scan of the texts."""
    rows = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    tokens = saved(with_tokens(with_base(rows)).drop("_t"), keep=True)
    uneven, cuts = calibrate(tokens)
    return tokens.withColumn("_random", _random(uneven, cuts)).drop("_tokens")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _assign, _access, _hex, _random): the spans of each row.

    A null text counts as empty.  Rows are scanned one by one; only the corpus's
    thresholds depend on other rows.  Rows that repeat an id, and null ids, are
    rows like others; further columns are not read; an empty table gives an
    empty result.
    """
    return _scanned(docs, F.col(f"`{id_col}`"), text_col).withColumnRenamed("_row", id_col)


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of ``kinds``, by start and then kind."""
    def ranked(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind))
        return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), rank.alias("k"), x["e"].alias("e")))

    all_ = F.concat(*map(ranked, kinds))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(all_), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` and ``n_chars`` renewed where one was.

    All columns are returned, whatever their names, and none of them but the text
    is changed or read; null texts stay null, and an empty table stays empty.
    """
    found = _scanned(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col)
    pair = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    spans = F.sort_array(F.concat(*[F.transform(f"_{kind}", pair) for kind in KINDS]))
    t = F.col("_row").getField(text_col).cast("string")

    def piece(a: Column, b: Column) -> Column:
        """Code points a to b of the text, without counting from its start."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        block = lambda k: F.get("_blocks", k)
        far = F.concat(block(first).substr(a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice("_blocks", first + 2, last - first - 1), ""), block(last).substr(F.lit(1), b - last * BLOCK))
        return F.when(b <= a, "").when(first == last, block(first).substr(a % BLOCK + 1, b - a)).otherwise(far)

    def step(acc: Column, i: Column) -> Column:
        x = F.get("_spans", i)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece(acc["at"], x["s"])))).alias("out"))

    end = F.array_max(F.transform("_spans", lambda x: x["e"]))
    done = F.array_join(F.concat(_folded(F.size("_spans"), "string", step), F.array(piece(end, F.length(t)))), mark)
    hit = F.size("_spans") > 0
    blocks = F.when(hit, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    made = found.withColumn("_spans", spans).withColumn("_blocks", blocks).withColumn("_new", F.when(hit, done))
    new = {text_col: F.when(hit, F.col("_new")).otherwise(F.col("_row").getField(text_col))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row").getField("n_chars"))
    return made.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: counts and offsets of the secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )
