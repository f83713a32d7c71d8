"""Secret scan: three patterns, and a battery of randomness tests for tokens that no pattern knows.  DataFrame functions only.

A token is a run of 20 or more characters of the base64 alphabets that mixes digits, lower and upper case, and that no
pattern's match overlaps.  Its encoding is inferred from its characters (hexadecimal, base32, base64), and its symbols
are tested as draws from that alphabet:

* chi-squared of uniformity over the smallest of `ALPHABETS` that has all its characters, with its exact mean and variance
  for the token's length (the sum of squared counts is the same over any of them);
* runs above and below the middle of the alphabet;
* correlation of each symbol with the next.

The squares of the three standardised statistics add up to one, which has three degrees of freedom if the token is
random; its tail bound is the battery's p-value.  For the discovery itself the null is a token of words: its chi-squared
has a mean and variance that grow with the length by the unevenness of letters, so that a short token needs to be far
more even than a long one.  The tail bound of that statistic is the second p-value.  Neither bound ever claims too much.

Both go through the procedure of Benjamini and Hochberg at the false-discovery rate `rate`, within bands of length, from
histograms of the p-values of all tokens of all texts: first it finds the tokens that aren't random, whose second p-value
is set to 1, and then those that aren't words.  The latter are the spans that are added.

The span of a match is the whole match.  Null texts are empty.  Texts without spans have empty lists and the digest of
the empty string.  Spans count code points.  A very long text is scanned whole; work grows with its length, as places are
summed in blocks of matches.  Repeated rows are scanned each by itself, and count each in the histograms.  An empty table
gives no rows.  Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The contract's patterns (fixed values): kind, pattern, group whose length counts, least length.  A shorter run of
#: access or hex never holds a longer one, so the length is part of the pattern there.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))
TOKEN = "[A-Za-z0-9+/_=\ue000-]{20,}"

HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Alphabets besides hexadecimal and base32, smallest first: what a token is made of, and how many symbols there are.
ALPHABETS = (("^[a-z2-7]+$", 32), ("^([0-9a-z]+|[0-9A-Z]+)$", 36), ("^[1-9A-HJ-NP-Za-km-z]+$", 58), ("^[0-9A-Za-z]+$", 62))


@dataclass(frozen=True)
class SecretConfig:
    rate: float = 0.01
    #: squared chance that two letters of words are the same, times the alphabet's size, less 1
    word_repeat: float = 0.066
    bands: tuple[int, ...] = (20, 28, 40, 64)
    step: float = 0.1
    most: float = 60.0


#: Stands for a character of a pattern's match; a text's own are blanked first.
MASK = "\ue000"
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Of every match: the characters before it since the last one, its own, those of the group, and the match itself."""
    found, value, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), value.alias("value"), found.alias("match"))
    return F.transform(rows, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), F.char_length(x["value"]).alias("n"), x["match"].alias("match")))


def _spans(pieces: Column, least: int, out: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """out(start, end, match) of every match that is long enough, an array of `kind`.

    Places are sums of what comes before, in blocks: over blocks, and within each.
    """
    zero = F.array().cast("array<int>")

    def of(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        part = lambda k: F.slice(p, k * BLOCK + 1, BLOCK)
        sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), zero.alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]

        def within(x: Column) -> Column:
            first = F.struct(x["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

            def add(a: Column, m: Column) -> Column:
                start = a["at"] + m["gap"]
                end = start + m["size"]
                return F.struct(end.alias("at"), F.when(m["n"] >= least, F.concat(a["out"], F.array(out(start, end, m["match"])))).otherwise(a["out"]).alias("out"))

            return F.aggregate(part(x["k"]), first, add)["out"]

        return F.flatten(F.transform(F.arrays_zip(blocks.alias("k"), starts.alias("at")), within))

    return _let(pieces, lambda p: F.when(F.size(p) > 0, of(p)).otherwise(F.array().cast(f"array<{kind}>")))


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """start, end and kind of every match that is long enough."""
    span = lambda start, end, _: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    return F.when(F.regexp_like(text, F.lit(pattern)), _spans(_pieces(text, pattern, group), least, span, "struct<start:int,end:int,kind:int>")).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int>>"))


def _masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with MASK for each character of the matches that are long enough."""
    found, value, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    rows = F.arrays_zip(between.alias("gap"), found.alias("match"), value.alias("value"))
    hidden = lambda x: F.when(F.char_length(x["value"]) >= least, F.repeat(F.lit(MASK), F.char_length(x["match"]))).otherwise(x["match"])
    return F.array_join(F.transform(rows, lambda x: F.concat(x["gap"], F.coalesce(hidden(x), F.lit("")))), "")


def _count(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def _statistics(alphabet: str, text: Column) -> Column:
    """Length, alphabet size, chi-squared, runs and serial correlation of a token's symbols."""
    size, half = len(alphabet), len(alphabet) // 2
    upper = F.translate(text, alphabet, "0" * half + "1" * (size - half))
    codes = F.transform(F.split(text, "(?!^)(?!$)"), lambda c: F.instr(F.lit(alphabet), c).cast("double"))

    def counted(x: Column) -> Column:
        n, ones = F.char_length(x["text"]).cast("double"), _count(x["upper"], "1")
        squares = sum((F.pow(_count(x["text"], c), F.lit(2.0)) for c in alphabet), F.lit(0.0))
        runs = 1 + _count(x["upper"], "01") + _count(x["upper"], "10")
        return F.struct(n.alias("n"), (squares * float(size) / n - n).alias("chi"), ones.alias("ones"), runs.alias("runs"), (F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / n).alias("middle"), x["codes"].alias("codes"))

    def standardised(x: Column) -> Column:
        n, codes, middle = x["n"], x["codes"], x["middle"]
        mean_runs = 1 + 2 * x["ones"] * (n - x["ones"]) / n
        var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
        spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - middle) * (c - middle))
        both = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("x"), F.slice(codes, 2, F.size(codes) - 1).alias("y"))
        product = F.aggregate(both, F.lit(0.0), lambda a, p: a + (p["x"] - middle) * (p["y"] - middle))
        return F.struct(
            n.alias("n"), F.lit(float(size)).alias("size"), x["chi"].alias("chi"),
            ((x["runs"] - mean_runs) / F.sqrt(var_runs)).alias("z_runs"),
            (F.sqrt(n) * product / F.greatest(spread, F.lit(1e-9))).alias("z_serial"),
        )

    return _let(_let(F.struct(text.alias("text"), upper.alias("upper"), codes.alias("codes")), counted), standardised)


def _tested(span: Column, token: Column, config: SecretConfig) -> Column:
    """start, end, length band, and bins of -log10 p: of the battery, and against words."""

    def inferred(body: Column) -> Column:
        is_hex, is_32 = body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), body.rlike("^[A-Z2-7]+$")
        s = F.when(is_hex, _statistics(HEX, F.lower(body))).when(is_32, _statistics(BASE32, body)).otherwise(_statistics(BASE64, body))
        fitting = F.coalesce(F.when(is_hex, 16), F.when(is_32, 32), *(F.when(body.rlike(pattern), size) for pattern, size in ALPHABETS), F.lit(64)).cast("double")
        return _let(F.struct(s.alias("s"), fitting.alias("fitting")), judged)

    def judged(x: Column) -> Column:
        s, fitting = x["s"], x["fitting"]
        free, n, own = s["size"] - 1, s["n"], x["fitting"] - 1
        z_even = ((s["chi"] + n) * fitting / s["size"] - n - own) / F.sqrt(2 * own * (n - 1) / n)
        uneven = (n - 1) * F.greatest(s["size"] * config.word_repeat - 1, F.lit(0.5))
        z = (free + uneven - s["chi"]) / F.sqrt(2 * free + 4 * uneven)
        word = F.when(z > 0, (z * z / 2 + F.log(F.lit(2.0))) / F.log(F.lit(10.0))).otherwise(0.0)
        # the tail bound of a chi-squared of three degrees of freedom
        x = z_even * z_even + s["z_runs"] * s["z_runs"] + s["z_serial"] * s["z_serial"]
        battery = F.when(x > 3, (x - 3 - 3 * F.log(x / 3)) / 2 / F.log(F.lit(10.0))).otherwise(0.0)
        band = sum((F.when(n >= b, 1).otherwise(0) for b in config.bands[1:]), F.lit(0))
        binned = lambda p: F.floor(F.least(p, F.lit(config.most)) / config.step).cast("int")
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), band.alias("band"), binned(battery).alias("battery"), binned(word).alias("word"))

    return _let(F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", ""), inferred)


def _candidates(text: Column, config: SecretConfig) -> Column:
    """Tested tokens.  A token that a match overlaps has a MASK in the text that hides the matches of that kind."""
    # only what mixes cases or has digits, besides a capital at the begin
    mixed = lambda t: (t.rlike("[0-9]").cast("int") + t.rlike("[a-z]").cast("int") + t.rlike(".[A-Z]").cast("int")) >= 2

    def tokens(of: Column) -> Column:
        pieces = F.when(F.regexp_like(of, F.lit(TOKEN)), _pieces(of, TOKEN, 0)).otherwise(F.array().cast("array<struct<gap:int,size:int,n:int,match:string>>"))
        named = _spans(pieces, 20, lambda start, end, match: F.concat_ws(":", start, end, match), "string")
        return F.filter(named, lambda x: ~F.contains(x, F.lit(MASK)) & mixed(F.substring_index(x, ":", -1)))

    own = F.translate(text, MASK, " ")
    clear = None
    for _, pattern, group, least in KINDS:
        some = F.when(F.regexp_like(text, F.lit(pattern)), tokens(_masked(own, pattern, group, least)))
        clear = some if clear is None else _let(F.struct(clear.alias("a"), some.alias("b")), lambda x: F.coalesce(F.array_intersect(x["a"], x["b"]), x["a"], x["b"]))
    named = _let(clear, lambda x: F.coalesce(x, tokens(own)))

    def tested(x: Column) -> Column:
        parts = F.split(x, ":", 3)
        return _let(F.struct(F.get(parts, F.lit(0)).cast("int").alias("start"), F.get(parts, F.lit(1)).cast("int").alias("end"), F.get(parts, F.lit(2)).alias("token")), lambda t: _tested(t, t["token"], config))

    return F.transform(named, tested)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*(F.lit(k) for k in ("assign", "access", "hex", "random")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scanned(docs: DataFrame, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans by start and kind) and tokens (tested candidates) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = F.concat(*(_matches(F.col("text"), p, g, n, k) for k, (_, p, g, n) in enumerate(KINDS)))
    return rows.select("doc_id", base.alias("base"), _candidates(F.col("text"), config).alias("tokens"))


def least_bins(counts: dict[tuple[int, int], int], config: SecretConfig) -> dict[int, int]:
    """counts of (band, bin).  The least bin of each band at which Benjamini and Hochberg still discover."""
    out = {}
    for band in range(len(config.bands)):
        bins = sorted(((at, n) for (own, at), n in counts.items() if own == band), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for at, n in bins:
            above += n
            if 10 ** (-at * config.step) <= config.rate * above / total:
                out[band] = at
    return out


def _discovered(x: Column, column: str, least: dict[int, int]) -> Column:
    out = F.lit(False)
    for band, at in least.items():
        out = out | ((x["band"] == band) & (x[column] >= at))
    return out


def secrets(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, base and added spans (start, end, kind number) of every row."""
    found = written(scanned(docs, config), "secrets")

    def histogram(bin_: Callable[[Column], Column]) -> dict[tuple[int, int], int]:
        binned = F.transform("tokens", lambda x: F.struct(x["band"].alias("band"), bin_(x).alias("bin")))
        rows = found.select(F.explode(binned).alias("t")).groupBy("t.band", "t.bin").count().collect()  # bands times bins at most
        return {(r["band"], r["bin"]): r["count"] for r in rows}

    even = least_bins(histogram(lambda x: x["battery"]), config)
    # the p-value of a token that isn't random is 1
    word = lambda x: F.when(_discovered(x, "battery", even), 0).otherwise(x["word"])
    words = least_bins(histogram(word), config)
    added = F.filter("tokens", lambda x: ~_discovered(x, "battery", even) & _discovered(x, "word", words))
    return found.select("doc_id", "base", F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(3).alias("kind"))).alias("added"))


def secret_digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_random"))
