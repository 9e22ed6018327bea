"""Secret scan: fixed patterns, and a battery of randomness tests over unlabelled tokens.

Everything is SQL expressions. A pass over the texts finds the pattern spans and, in every text, the long tokens of
encoding characters. Each token gets its encoding (the smallest alphabet that holds it) and three statistics of it:
chi-squared of the symbol counts, runs of symbols on the same side (digits and letters, or upper and lower case; halves of
the alphabet where there is one class), and the serial correlation of neighbours.

Each statistic has two distributions. If the token was drawn evenly and independently from its alphabet, all three are about
normal; a token is not called random if one of them rejects that. If it is written - words, names, paths - symbols coincide
as often as letters of a language do, neighbours seldom change sides and go together: against this the same three statistics
give p-values, which depend on the token's length by themselves, and the least of them times three is the token's p-value.
Benjamini and Hochberg's rule, within bands of length, holds the share of false discoveries among all tokens of the table;
it reads a histogram of p-values, of a fixed number of bins. A token of letters of one case can hardly be told from a word
by these tests unless it is very long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize, whole_text

# The patterns of the base kinds, in their order; an access key has 20 characters, a hexadecimal run 24.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_SMALL, _LARGE, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Of an encoding: its pattern, its alphabet in order, and the symbols of one side for the runs test. The smallest come first.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS, _DIGITS[:5]),
    (r"^[0-9a-f]+$", _DIGITS + _SMALL[:6], _DIGITS),
    (r"^[0-9A-F]+$", _DIGITS + _LARGE[:6], _DIGITS),
    (r"^[a-z]+$", _SMALL, _SMALL[:13]),
    (r"^[A-Z2-7]+=*$", _DIGITS[2:8] + _LARGE, _DIGITS[2:8]),
    (r"^[a-z0-9]+$", _DIGITS + _SMALL, _DIGITS),
    (r"^[A-Za-z]+$", _LARGE + _SMALL, _LARGE),
    (r"^[A-Za-z0-9]+$", _DIGITS + _LARGE + _SMALL, _DIGITS + _LARGE),
    (r"", "+-/" + _DIGITS + "=" + _LARGE + "_" + _SMALL, "+-/" + _DIGITS + "=" + _LARGE + "_"),
)
#: In which of them neighbours of a written text seldom change sides.
SIDED = tuple(side not in (_DIGITS[:5], _SMALL[:13]) for _, _, side in ENCODINGS)
#: Of written text: how often two letters coincide and three do beyond that, and how often neighbours change sides.
COINCIDE, CLUSTER, CHANGE = 0.065, 0.001, 0.08
BANDS, BINS = (24, 32, 48, 80, 160), 400
SPAN = "array<struct<start:int,kind:int,end:int>>"


def match_spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans (start, kind, end; code points) of the leftmost non-overlapping matches whose group has ``least`` characters."""
    found, held = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("size"), F.transform(held, lambda x: F.length(x)).alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, x: Column) -> Column:
        at = done["at"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["size"]).alias("end"))
        return F.struct((at + x["size"]).alias("at"), F.concat(done["out"], F.when(x["held"] >= least, F.array(span)).otherwise(F.array()).cast(SPAN)).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(both, start, step, lambda x: x["out"])).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """P(|N| >= |z|), by a logistic approximation that is good to 0.0002."""
    x = F.least(F.abs(z), F.lit(8.0))
    return 2 / (1 + F.exp(0.07056 * x * x * x + 1.5976 * x))


def lower_tail(z: Column) -> Column:
    """A bound on -ln P(N <= z): zero for z of zero or more."""
    return F.when(z < 0, z * z / 2 + 0.6931).otherwise(0.0)


def drift(alphabet: str) -> float:
    """Mean product of neighbours' offsets from the alphabet's middle, by its variance, if all symbols are lower case."""
    small = [i for i, c in enumerate(alphabet, 1) if c.islower()]
    k = len(alphabet)
    offset = sum(small) / len(small) - (k + 1) / 2 if small and len(small) < k else 0.0
    return offset * offset / ((k * k - 1) / 12)


def battery(token: Column) -> Column:
    """Of a token: its encoding, p_random, the least of the p-values of its three statistics if it is random, and p_bin, the bin
    of its p-value if it is written, which the same three statistics give.

    A bin is a tenth of a power of ten; it is rounded down, so a p-value counts as no less than it is.
    """
    body = F.regexp_replace(token, "=+$", "")
    encoding = F.lit(len(ENCODINGS) - 1)
    for i, (pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        encoding = F.when(token.rlike(pattern), i).otherwise(encoding)
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), encoding + 1)
    alphabet = of([a for _, a, _ in ENCODINGS])
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    n, k = F.size(chars).cast("double"), F.length(alphabet).cast("double")
    # Chi-squared, and the number of pairs that coincide, of which it is a linear function.
    squares = F.aggregate(chars, F.lit(0.0), lambda s, c: s + (n - F.length(F.replace(body, c, F.lit("")))))
    chi_z = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    often = of([max(COINCIDE, 2 / len(a)) for _, a, _ in ENCODINGS])
    expected = n * (n - 1) / 2 * often
    spread = expected * (1 - often) + n * (n - 1) * (n - 2) * CLUSTER
    written_chi = lower_tail(((squares - n) / 2 - expected) / F.sqrt(spread))
    # Runs, one more than the changes of side.
    codes = F.transform(chars, lambda c: F.position(c, alphabet).cast("double"))
    centre = (k + 1) / 2
    side = F.transform(chars, lambda c: F.position(c, of([x for _, _, x in ENCODINGS])) > 0)
    high = F.aggregate(side, F.lit(0.0), lambda s, x: s + F.when(x, 0.0).otherwise(1.0))
    pairs = F.arrays_zip(F.slice(codes, 1, F.size(chars) - 1).alias("a"), F.slice(codes, 2, F.size(chars) - 1).alias("b"))
    sides = F.arrays_zip(F.slice(side, 1, F.size(chars) - 1).alias("a"), F.slice(side, 2, F.size(chars) - 1).alias("b"))
    runs = F.aggregate(sides, F.lit(1.0), lambda s, p: s + F.when(p["a"] != p["b"], 1.0).otherwise(0.0))
    low = n - high
    runs_mean = 2 * high * low / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    runs_z = F.when(runs_var > 0, (runs - runs_mean) / F.sqrt(runs_var)).otherwise(8.0)
    steps, share = n - 1, F.least((runs - 1) / (n - 1), F.lit(0.999))
    chernoff = steps * (share * F.log(share / CHANGE) + (1 - share) * F.log((1 - share) / (1 - CHANGE)))
    written_runs = F.when(of(SIDED) & (share > CHANGE), chernoff).otherwise(0.0)
    # Serial correlation.
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - centre) * (p["b"] - centre))
    serial_z = serial / ((k * k - 1) / 12) / F.sqrt(n - 1)
    usual = of([drift(a) for _, a, _ in ENCODINGS])
    written_serial = F.when(usual > 0, lower_tail((serial_z - usual * F.sqrt(n - 1)) / 1.5)).otherwise(0.0)
    p_random = F.least(normal_tail(chi_z), normal_tail(runs_z), normal_tail(serial_z))
    tail = F.greatest(F.greatest(written_chi, written_runs, written_serial) - 1.0986, F.lit(0.0))
    p_bin = F.least(F.floor(tail * (10 / 2.302585)), F.lit(BINS - 1)).cast("int")
    return F.struct(encoding.alias("encoding"), p_random.alias("p_random"), p_bin.alias("p_bin"))


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, edge in enumerate(BANDS, 1):
        out = F.when(length >= edge, i).otherwise(out)
    return out


def thresholds(tokens: DataFrame, rate: float) -> dict[int, int]:
    """For each band of length the least bin that Benjamini and Hochberg's rule accepts at the rate; ``tokens``: band, p_bin."""
    counts = tokens.groupBy("band", "p_bin").agg(F.count("*").alias("n"))  # bands x bins at most
    down = Window.partitionBy("band").orderBy(F.desc("p_bin"))
    level = F.pow(F.lit(10.0), -F.col("p_bin") / 10)
    ok = counts.select("band", "p_bin", level.alias("p"), F.sum("n").over(down).alias("as_small"), F.sum("n").over(Window.partitionBy("band")).alias("all")).where(F.col("p") * F.col("all") <= rate * F.col("as_small"))
    return {r.band: r.bin for r in ok.groupBy("band").agg(F.min("p_bin").alias("bin")).collect()}


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) and ``secret_spans``: spans (start, kind, end) by start and kind, kinds as in KINDS.

    Needs ``text``; null counts as empty. ``rate`` bounds the share of false discoveries among the tested tokens (all of 20
    encoding characters or more, of any encoding), ``level`` is that of each randomness test. Base spans stay whatever the tests say; a random token
    that overlaps one adds no span. Repeated rows get each their spans; an empty table gives an empty result; a column of
    the name ``secret_spans`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "secret_spans"]
    text = whole_text()
    base = F.concat(match_spans(text, ASSIGN, 0, 6, 2), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))
    tokens = F.transform(match_spans(text, TOKEN, 3), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token")))
    some = F.filter(tokens, lambda s: F.length(F.regexp_replace(s["token"], "=+$", "")) > 2)
    tested = F.transform(some, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), band(s["end"] - s["start"]).alias("band"), battery(s["token"]).alias("test")))
    kept = materialize(docs.select(*names, F.array_sort(base).alias("_base"), tested.alias("_tested")))
    least = thresholds(kept.select(F.explode("_tested").alias("t")).select("t.band", "t.test.p_bin"), rate)
    limits = F.array(*(F.lit(least.get(b, BINS)) for b in range(len(BANDS) + 1)))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    taken = F.filter("_tested", lambda s: (s["test"]["p_bin"] >= F.get(limits, s["band"])) & (s["test"]["p_random"] >= level) & free(s))
    added = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    return kept.select(*names, F.array_sort(F.concat("_base", added)).alias("secret_spans"))


def described(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``; ``spans`` are in order of their starts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], F.when(fresh, F.concat(between, F.lit(mark))).otherwise("")).alias("out"))

    whole = F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
