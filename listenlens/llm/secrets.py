"""Secret scan with a randomness test battery, in DataFrame functions only.

Base spans are regular-expression matches of three kinds.  The method adds spans
of kind ``random``: runs of token characters whose symbols look drawn at random.
For each run the smallest usual alphabet that holds it is inferred (``ENCODINGS``)
and three statistics are taken over it:

* chi-squared uniformity of the symbol counts,
* the runs test on symbols above and below the alphabet's middle,
* the lag-1 serial correlation of the symbol numbers.

The p-value that counts is that of ordinary text: the chance that text held by the
same alphabet is as unlikely, symbol by symbol, as the run.  Its model is the symbol
pairs of all words of the corpus, case folded and limited to the alphabet, so that
hex runs are held against words and numbers of hex symbols.  Digits of text are near
uniform, so decimal runs are held against sequential and repeated digits
(``STEPS``) instead: long numbers of other origin, such as time stamps, are not told
from random ones.  The Benjamini-Hochberg rule over all distinct runs of the corpus,
within an encoding and length class (``LENGTHS``), picks the runs that are too unlike
text at a false-discovery rate of ``FDR``; a run that then fails one of the three
tests as a random string (at ``REJECT``) is left out again.
P-values meet as counts in a fixed number of bins, so no task sorts them.

Defined cases: a null text is empty; texts without a match have empty spans;
repeated rows are each scanned; an empty table gives no rows; other columns are
ignored.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlens.llm.common import store

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# greedy runs: asking for the least length finds the same matches as filtering by it
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN

# symbols of the text model: letters without case, digits, one for all others
FOLDED = "abcdefghijklmnopqrstuvwxyz0123456789-"
# pseudo-count that pulls a symbol's followers towards the symbol frequencies
PULL = 10.0
# sums over real text vary more than independent pairs would: factor of the variance
SPREAD = 2.0
# share of steps by 0 or 1 in sequential and repeated digits
STEPS = 0.8
# a word is counted in pieces of this length, which bounds the work on a long one
_PIECE = 32
FDR = 0.01
REJECT = 0.001
LENGTHS = (20, 24, 32, 48, 80)
# a p-value's bin is floor(-BINS_PER_DECADE * log10 p), at most MAX_BIN
BINS_PER_DECADE, MAX_BIN = 20, 600

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# name -> (pattern of the symbols, alphabet in order), smallest first
ENCODINGS = {
    "decimal": ("[0-9]+", _DIGITS),
    "hex": ("([0-9a-f]+|[0-9A-F]+)", _DIGITS + "abcdef"),
    "upper": ("[A-Z]+", _UPPER),
    "lower": ("[a-z]+", _LOWER),
    "base32": ("[A-Z2-7]+", _UPPER + "234567"),
    "upper36": ("[A-Z0-9]+", _DIGITS + _UPPER),
    "lower36": ("[a-z0-9]+", _DIGITS + _LOWER),
    "letters": ("[A-Za-z]+", _UPPER + _LOWER),
    "base62": ("[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER),
    "base64": ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    "other": (".*", _UPPER + _LOWER + _DIGITS + "+/-_="),
}

# a code point that no text can mean; one in a text is replaced, which keeps all places
_MARK, _REPLACED = "\uFDD0", "\uFFFD"
_CHUNK = 256


def _pieces(text: str, pattern: str) -> Column:
    """The text cut before and after every match: matches are the odd pieces."""
    marked = F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    return F.when(F.col(text).rlike(pattern), F.split(marked, _MARK, -1)).otherwise(F.array(F.lit("")))


def _step(df: DataFrame, drop=(), **columns) -> DataFrame:
    """Adds columns as the output of a one-row generator.

    The optimizer keeps a generator's output as it is, whereas plain columns would
    be copied into the lambdas that use them and run again for every element.
    """
    kept = [c for c in df.columns if c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds, for each pattern, an array of (start, end, m) of its matches, leftmost and
    non-overlapping, in place of the text.

    Places are sums of piece lengths, taken in two levels so that long arrays stay linear.
    """
    add = "(acc, x) -> concat(acc, array(element_at(acc, -1) + x))"
    each = lambda f: {f"{c}_{k}": F.expr(e.replace("?", k)) for k in patterns for c, e in f.items()}
    df = _step(df, [text], **{f"p_{k}": _pieces(text, p) for k, p in patterns.items()})
    df = _step(df, **each({"l": "transform(p_?, x -> cast(char_length(x) AS bigint))"}))
    df = _step(df, **each({"c": f"transform(sequence(0, (size(l_?) - 1) div {_CHUNK}), c -> slice(l_?, c * {_CHUNK} + 1, {_CHUNK}))"}))
    df = _step(df, **each({"b": f"aggregate(transform(c_?, ch -> aggregate(ch, 0L, (a, x) -> a + x)), array(0L), {add})"}))
    df = _step(df, **each({"s": f"flatten(transform(c_?, (ch, i) -> slice(aggregate(ch, array(b_?[i]), {add}), 1, size(ch))))"}))
    return df.select(*[c for c in df.columns if c[1:] not in {f"_{k}" for k in patterns}], *[F.expr(
        f"if(size(p_{k}) < 3, cast(array() AS array<struct<start: bigint, end: bigint, m: string>>), "
        f"transform(sequence(1, greatest(1, size(p_{k}) - 2), 2), i -> named_struct("
        f"'start', s_{k}[i], 'end', s_{k}[i] + l_{k}[i], 'm', p_{k}[i])))").alias(k) for k in patterns])


# ---- statistics of one run -------------------------------------------------------

def normal_below(z: Column) -> Column:
    """P(Z < z): rational approximation near 0, asymptotic series in the tails."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) * 0.3989422804014327
    tail = F.when(a < 4, density * poly).otherwise(density / a * (1 - 1 / (a * a) + 3 / F.pow(a, F.lit(4.0))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def text_pairs(docs: DataFrame) -> np.ndarray:
    """How often each folded symbol follows each other one in the words of all texts."""
    # words are counted first: there are far fewer than symbols
    words = (docs.select(F.explode(F.expr(f"regexp_extract_all(lower(cast(text AS string)), '[a-z0-9+/_=-]{{2,{_PIECE}}}', 0)")).alias("w"))
             .groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    pairs = (words.select(F.translate("w", "+/_=", "----").alias("w"), "n")
             .select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substr(w, i, 2))")).alias("pair"), "n")
             .groupBy("pair").agg(F.sum("n").alias("n")))
    out = np.zeros((len(FOLDED), len(FOLDED)))
    # at most a square of the symbols
    for r in pairs.collect():
        out[FOLDED.index(r.pair[0]), FOLDED.index(r.pair[1])] = r.n
    return out


def text_costs(pairs: np.ndarray, alphabet: str) -> tuple[np.ndarray, float, float]:
    """(-log P(symbol | one before), mean, variance) of text that holds symbols of the alphabet only."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    p = (pairs + PULL * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + PULL)
    on = np.array([c in {x if x.isalnum() else "-" for x in alphabet.lower()} for c in FOLDED])
    inside = p * on[None, :] / (p * on[None, :]).sum(axis=1, keepdims=True)
    cost = np.where(on[None, :], -np.log(np.where(on[None, :], inside, 1.0)), 0.0)
    # how often a symbol is followed by one of the alphabet
    weight = ((pairs.sum(axis=1) + 1) * (p * on[None, :]).sum(axis=1) * on)[:, None] * inside
    weight /= weight.sum()
    mean = float((weight * cost).sum())
    return cost, mean, float((weight * cost ** 2).sum()) - mean ** 2


def _unlike_text(pairs: np.ndarray, name: str, run: Column, n: Column) -> Column:
    """z of the run as text held by an encoding's alphabet; far below 0 for random runs."""
    alphabet = ENCODINGS[name][1]
    steps = n - 1
    if name == "decimal":
        digits = F.split(run, "")
        small = F.size(F.filter(F.zip_with(digits, F.slice(digits, F.lit(2), F.size(digits)), lambda x, y: F.pmod(
            x.cast("int") - y.cast("int") + 1, F.lit(10)) <= 2), lambda x: x))
        return (small - STEPS * steps) / F.sqrt(STEPS * (1 - STEPS) * steps)
    cost, mean, variance = text_costs(pairs, alphabet)
    if variance <= 1e-9:
        return F.lit(None).cast("double")
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in cost.ravel())), ",").cast("array<double>")
    codes = F.transform(F.split(F.translate(F.lower(run), "+/_=", "----"), ""), lambda c: F.instr(F.lit(FOLDED), c) - 1)
    total = F.aggregate(F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda x, y: F.coalesce(
        F.get(table, x * len(FOLDED) + y), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    return (mean * steps - total) / F.sqrt(SPREAD * variance * steps)


def p_z(pairs: np.ndarray, token: str = "m") -> Column:
    """z of each run as ordinary text of its alphabet, given columns encoding and n."""
    z = F.lit(None).cast("double")
    for name in reversed(ENCODINGS):
        z = F.when(F.col("encoding") == name, _unlike_text(pairs, name, F.col(token), F.col("n"))).otherwise(z)
    return z


def statistics(runs: DataFrame, token: str = "m") -> DataFrame:
    """Adds encoding, n, chi2, p_uniform, p_runs, p_serial of a run column."""
    t = F.col(token)
    enc = F.coalesce(*[F.when(t.rlike(f"^{p}$"), F.lit(name)) for name, (p, _) in ENCODINGS.items()])
    df = _step(runs, encoding=enc)

    def by_encoding(value) -> Column:
        out = F.lit(None)
        for name, (_, alphabet) in reversed(ENCODINGS.items()):
            out = F.when(F.col("encoding") == name, value(alphabet)).otherwise(out)
        return out

    every = F.array(*[F.lit(c) for c in _DIGITS + _UPPER + _LOWER + "+/_=-"])
    symbol = F.when((F.col("encoding") == "hex"), F.lower(t)).otherwise(t)
    df = _step(
        df, symbols=symbol, n=F.length(t).cast("double"), k=by_encoding(lambda a: F.lit(float(len(a)))),
        # symbols of the alphabet's upper half as 1, the others as 0
        halves=by_encoding(lambda a: F.translate(symbol, a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))),
        numbers=by_encoding(lambda a: F.transform(F.split(symbol, ""), lambda c: F.instr(F.lit(a), c).cast("double"))))
    squares = F.aggregate(every, F.lit(0.0), lambda acc, c: acc + F.pow(
        F.col("n") - F.length(F.replace(F.col("symbols"), c, F.lit(""))), F.lit(2.0)))
    ones = F.col("n") - F.length(F.replace(F.col("halves"), F.lit("1"), F.lit("")))
    turns = (2 * F.col("n") - F.length(F.replace(F.col("halves"), F.lit("01"), F.lit("")))
             - F.length(F.replace(F.col("halves"), F.lit("10"), F.lit("")))) / 2
    total = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x)
    df = _step(df, squares=squares, ones=ones, turns=turns, mean=total / F.col("n"))
    nxt = F.expr("slice(numbers, 2, size(numbers))")
    moved = F.aggregate(F.zip_with("numbers", nxt, lambda x, y: (x - F.col("mean")) * (F.coalesce(y, F.col("mean")) - F.col("mean"))),
                        F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    df = _step(df, moved=moved, spread=spread)
    n, k, free = F.col("n"), F.col("k"), F.col("k") - 1
    df = _step(df, chi2=k / n * F.col("squares") - n, expected=2 * F.col("ones") * (n - F.col("ones")) / n + 1)
    # Wilson-Hilferty cube root for the uniform null
    cube = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    runs_spread = F.sqrt((F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1))
    df = _step(
        df, z_uniform=-cube,
        z_runs=F.when((F.col("expected") > 2) & (n > 1), -F.abs((F.col("turns") + 1 - F.col("expected")) / runs_spread)),
        z_serial=F.when(F.col("spread") > 0, -F.abs((F.col("moved") / F.col("spread") + 1 / n) * F.sqrt(n))))
    below = {x: normal_below(F.col(f"z_{x}")) for x in ("uniform", "runs", "serial")}
    return _step(df, ["symbols", "halves", "numbers", "squares", "ones", "turns", "mean", "moved", "spread", "k", "expected",
                      "z_uniform", "z_runs", "z_serial"],
                 p_uniform=below["uniform"], p_runs=F.coalesce(2 * below["runs"], F.lit(0.0)), p_serial=F.coalesce(2 * below["serial"], F.lit(0.0)))


def length_class(n: Column) -> Column:
    out = F.lit(LENGTHS[0])
    for least in LENGTHS[1:]:
        out = F.when(n >= least, F.lit(least)).otherwise(out)
    return out


def random_runs(runs: DataFrame, pairs: np.ndarray, fdr: float = FDR, reject: float = REJECT) -> DataFrame:
    """m, encoding and p-values of the distinct runs found random.

    Benjamini-Hochberg by bins: in an encoding and length class, the largest p-value bound with
    bound <= fdr * (runs up to it) / (all runs) is the threshold.
    """
    tested = _step(statistics(runs.select("m").distinct()), z=p_z(pairs))
    tested = (_step(tested, ["z"], p_text=F.coalesce(normal_below(F.col("z")), F.lit(1.0)))
              .withColumns({"class": length_class(F.col("n")),
                            "bin": F.least(F.lit(MAX_BIN), F.floor(-BINS_PER_DECADE * F.log10(
                                F.greatest(F.col("p_text"), F.lit(1e-300))))).cast("int")}))
    counts = tested.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("c"))
    # at most len(ENCODINGS) * len(LENGTHS) * (MAX_BIN + 1) rows; larger bins are smaller p-values
    w = Window.partitionBy("encoding", "class")
    sums = counts.withColumns({"upto": F.sum("c").over(w.orderBy(F.desc("bin"))), "all": F.sum("c").over(w)})
    bound = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    cut = (sums.filter(bound <= F.lit(fdr) * F.col("upto") / F.col("all"))
           .groupBy("encoding", "class").agg(F.min("bin").alias("cut")))
    return (tested.join(cut, ["encoding", "class"]).filter((F.col("bin") >= F.col("cut"))
                                             & (F.least("p_uniform", "p_runs", "p_serial") >= reject))
            .drop("bin", "cut", "class"))


# ---- scan ------------------------------------------------------------------------

def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and the matches of every kind, and of token runs; stored, so texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.replace(text, F.lit(_MARK), F.lit(_REPLACED)).alias("text"))
    rows = with_matches(d, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": RUN}).drop("text")
    long_enough = F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    return store(rows.withColumns({"assign": long_enough, "row": F.monotonically_increasing_id()}), "secret-matches")


def scan(docs: DataFrame, fdr: float = FDR, reject: float = REJECT) -> DataFrame:
    """doc_id, base and found (arrays of start, kind number, end, m, in order): one row per document row."""
    rows = matches(docs)
    runs = rows.select("row", F.explode("run").alias("x")).select("row", "x.start", "x.end", "x.m")
    added = (runs.join(random_runs(runs, text_pairs(docs), fdr, reject).select("m"), "m")
             .groupBy("row").agg(F.collect_list(F.struct(
                 "start", F.lit(KINDS.index("random")).alias("kind"), "end", "m")).alias("random")))
    def of_kind(k: str) -> Column:
        return F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"),
                                                 x["end"].alias("end"), x["m"].alias("m")))

    base = F.array_sort(F.concat(*map(of_kind, KINDS[:3])))
    return (rows.select("row", "doc_id", base.alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]])
            .join(added, "row", "left")
            .withColumn("found", F.when(F.col("random").isNull(), F.col("base"))
                        .otherwise(F.array_sort(F.concat("base", "random"))))
            .drop("row", "random"))


def written(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written("base"), 256).alias("base_sha256"),
                        written("found").alias("spans"))
