"""Quality rules (operator 10), with DataFrame functions only: robust multivariate outliers.

Every text gets its counts, and from them a vector of ``VECTOR`` transformed statistics. For each language and source a
minimum-covariance-determinant estimate tells where the bulk of its vectors lies: from two deterministic starts, each
concentration step keeps the ``SHARE`` of rows with the least distance and takes their mean and covariance, until no
group's determinant falls any more, and the start with the smaller determinant wins. Few rows say little, so the
estimate is regularised: a group's mean and covariance are averaged with those of its language, as if that were
``SHRINK`` rows more, and a language's with those of all rows. A row is rejected if its squared Mahalanobis distance
exceeds ``CUTOFF`` or a base rule fails.

Texts are read once; the steps work on the table of vectors. Every step is a grouped sum or a mergeable quantile, so a
group of any size is combined before the shuffle; the wider estimates are sums of the groups' sums; and only estimates
(one row a group) are joined back: broadcast while there are ``BROADCAST_GROUPS`` of them at most, by a shuffle beyond.

Windows of words are compared by hashes; in the few texts with equal ones the words themselves are compared, so two
windows count as one only if they are.

Defined results: null text counts as empty: no words, base rule failed; null languages and sources are groups of their
own; a floor keeps covariances regular when a group has no scatter, as that of a single row or of ties only; a very long
text is one row like others; repeated rows each give a row; an empty table gives an empty one; other columns of the
input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.shared import discard, materialise

#: Words that a window spans; the base rule's bounds.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
VECTOR = ("word_length", "symbols", "distinct", "upper")
#: Share of rows that a concentration step keeps; accuracy of its quantile; rows that the wider estimate counts as.
SHARE, ACCURACY, SHRINK = 0.75, 2000, 50.0
#: Fall of a log-determinant up to which a group counts as settled (a step can only lower it, but for the quantiles' small
#: error and what the wider estimates move); steps at most, of which three to five are made in practice.
SETTLED, STEPS = 0.01, 40
#: A prior count that steadies rates of short texts.
PRIOR = 30.0
#: Standard deviation below which no direction of a group counts as narrower.
FLOOR = 0.03
#: Bits of a number that hold a window's place, as arrays have no more; the others are of its hash.
PLACE_BITS = 31
#: Groups whose estimates are broadcast at most.
BROADCAST_GROUPS = 20_000


def tail_cutoff(d: int, tail: float) -> float:
    """The squared distance that a share ``tail`` of a Gaussian's rows exceeds, in an even number ``d`` of dimensions."""
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))
    lo, hi = 0.0, 2000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > tail else (lo, mid)
    return hi


#: Squared distance beyond which a row is rejected: one that no Gaussian row of the largest corpora (10^12 texts) reaches.
CUTOFF = tail_cutoff(len(VECTOR), 1e-12)

_BLANK = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words of an array in windows that are in it twice or more."""
    one_by_one = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    # the first bits of the hash and the place in one number, whose order is that of hashes, then of places
    head = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    pack = lambda x, i: F.shiftleft(head(x), PLACE_BITS).bitwiseOR(i.cast("long"))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    word = lambda x, k: F.get(words, place(x) + k)

    def beside(ordered: Column) -> Column:
        """Those with the hash of the one before or after."""
        twice = lambda x, k: (head(F.get(ordered, k - 1)) == head(x)) | (head(F.get(ordered, k + 1)) == head(x))
        return F.filter(ordered, lambda x, k: F.coalesce(twice(x, k), F.lit(False)))

    def differ(found: Column) -> Column:
        """Whether windows of equal hashes are of different words anywhere."""
        after = lambda k: F.get(found, k + 1)
        unlike = lambda x, k: ~_all([word(x, n) == word(after(k), n) for n in range(WINDOW)])
        off = F.transform(found, lambda x, k: F.coalesce((head(x) == head(after(k))) & unlike(x, k), F.lit(False)))
        return F.exists(off, lambda x: x)

    def by_words(found: Column) -> Column:
        """As ``beside``, by the words themselves; a blank is in no word."""
        spelt = F.array_sort(F.transform(found, lambda x: F.struct(F.array_join(F.slice(words, place(x) + 1, WINDOW), " ").alias("w"), x.alias("x"))))

        def only_twice(s: Column) -> Column:
            twice = lambda y, k: (F.get(s, k - 1)["w"] == y["w"]) | (F.get(s, k + 1)["w"] == y["w"])
            return F.transform(F.filter(s, lambda y, k: F.coalesce(twice(y, k), F.lit(False))), lambda y: y["x"])

        return _let(spelt, only_twice)

    def covered(found: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(F.transform(found, place)), start, add, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        exact = lambda found: covered(F.when(differ(found), by_words(found)).otherwise(found))
        places = _let(_let(F.sort_array(F.transform(h, pack)), beside), exact)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places)

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(_let(one_by_one, hashes), count))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``id_col`` and ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_upper."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, _BLANK + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    rows = docs.select(
        id_col,
        *keep,
        of_words.alias("_w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return rows.select(id_col, *keep, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "_w.n_distinct", "n_upper")


def vector() -> list[Column]:
    """The transformed statistics, from the columns of ``text_counts``."""
    rate = lambda k, of: F.sqrt(F.col(k) / (F.col(of) + PRIOR))
    return [
        F.log((F.col("word_chars") + 5 * PRIOR) / (F.col("n_words") + PRIOR)),
        rate("n_symbols", "word_chars"),
        F.log((F.col("n_distinct") + PRIOR) / (F.col("n_words") + PRIOR)) / F.log(F.col("n_words") + 20.0),
        rate("n_upper", "word_chars"),
    ]


def _chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution function, by the series of the lower incomplete gamma function."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 400):
        term *= y / (a + n)
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def consistency(share: float, d: int) -> float:
    """Factor by which the covariance of the nearest ``share`` of a Gaussian's rows is too small."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, d) < share else (lo, mid)
    return share / _chi2_cdf(lo, d + 2)


def _triangle(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


# The expressions below are SQL text: each is one call to the JVM, where columns built piece by piece are thousands.


def _columns(d: int) -> list[str]:
    """Names of the sums of both starts: n, means' and products' sums."""
    return [f"{x}_{k}" for k in (0, 1) for x in ("n", *[f"s{i}" for i in range(d)], *[f"s{i}_{j}" for i, j in _triangle(d)])]


def _sums(rows: DataFrame, d: int) -> DataFrame:
    """g, p, was_0, was_1, and by start the number and sums of the rows (x0.., q0, q1) within the group's cuts."""

    def of(k: int) -> list[Column]:
        near = lambda x: f"sum(CASE WHEN q{k} <= cut{k} THEN {x} END)"
        values = [near("1.0D"), *[near(f"x{i}") for i in range(d)], *[near(f"x{i} * x{j}") for i, j in _triangle(d)]]
        return [F.expr(f"max(was_{k}) AS was_{k}"), *[F.expr(v).alias(c) for v, c in zip(values, [c for c in _columns(d) if c.endswith(f"_{k}")])]]

    return rows.groupBy("g", "p").agg(*of(0), *of(1))


def _moments(d: int, k: int) -> dict[str, str]:
    """The mean m{i} and covariance c{i}_{j} of start ``k``, from a struct of sums whose name is to be put for ``{}``."""
    n, factor = f"{{}}.n_{k}", consistency(SHARE, d)
    mean = lambda i: f"({{}}.s{i}_{k} / {n})"
    covariance = lambda i, j: f"({factor!r}D * ({{}}.s{i}_{j}_{k} / {n} - {mean(i)} * {mean(j)}) + {FLOOR**2 if i == j else 0.0!r}D)"
    return {f"m{i}": mean(i) for i in range(d)} | {f"c{i}_{j}": covariance(i, j) for i, j in _triangle(d)}


def _estimates(sums: DataFrame, d: int, shrink: float) -> DataFrame:
    """g, and by start k a struct e{k} of m0.., the inverse Cholesky factor w{i}_{j} of the shrunk covariance, logdet,
    and the logdet before (was). Groups are rows of ``sums``, so only those of languages and of all are sums again."""
    names = _columns(d)
    total = [F.expr(f"sum({c})").alias(c) for c in names]
    by_language = sums.groupBy("p").agg(*total)
    both = sums.selectExpr("g", "p", "was_0", "was_1", f"struct({', '.join(names)}) AS own")
    both = both.join(by_language.selectExpr("p", f"struct({', '.join(names)}) AS lang"), "p")
    both = both.join(F.broadcast(sums.agg(*total).selectExpr(f"struct({', '.join(names)}) AS whole")))  # one row
    out, shown = both, []
    less = lambda i, j, k: "".join(f" - l{i}_{n}_{k} * l{j}_{n}_{k}" for n in range(j))
    mix = lambda n, own, wide: f"(({n}) * {own} + {shrink!r}D * {wide}) / ({n} + {shrink!r}D)"
    for step in range(-1, 2 * d + d):
        made = []
        for k in (0, 1):
            if step == -1:
                for c, text in _moments(d, k).items():
                    language = mix(f"lang.n_{k}", text.replace("{}", "lang"), text.replace("{}", "whole"))
                    made.append(f"{mix(f'own.n_{k}', text.replace('{}', 'own'), language)} AS {c}_{k}")
            elif step < 2 * d:  # the factor, column by column: what doesn't depend on each other is made at once
                j, below = divmod(step, 2)
                if below:
                    made += [f"(c{i}_{j}_{k}{less(i, j, k)}) / l{j}_{j}_{k} AS l{i}_{j}_{k}" for i in range(j + 1, d)]
                else:
                    made.append(f"sqrt(greatest(c{j}_{j}_{k}{less(j, j, k)}, 1e-9D)) AS l{j}_{j}_{k}")
            else:  # its inverse, by diagonals
                off = step - 2 * d
                for j in range(d - off):
                    i = j + off
                    inner = " + ".join(f"l{i}_{n}_{k} * w{n}_{j}_{k}" for n in range(j, i))
                    made.append(f"{f'-({inner})' if off else '1'} / l{i}_{i}_{k} AS w{i}_{j}_{k}")
        if made:
            out = out.selectExpr("*", *made)
    for k in (0, 1):
        logdet = " + ".join(f"2 * ln(l{i}_{i}_{k})" for i in range(d))
        values = [f"'m{i}', m{i}_{k}" for i in range(d)] + [f"'w{i}_{j}', w{i}_{j}_{k}" for i, j in _triangle(d)]
        shown.append(f"named_struct({', '.join(values)}, 'logdet', {logdet}, 'was', was_{k}) AS e{k}")
    return out.selectExpr("g", *shown)


def distance(d: int, of: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. under the columns of an estimate, or those of the struct ``of``."""
    at = f"{of}." if of else ""
    part = lambda i: " + ".join(f"{at}w{i}_{j} * (x{j} - {at}m{j})" for j in range(i + 1))
    return F.expr(" + ".join(f"power({part(i)}, 2)" for i in range(d)))


def robust_estimates(rows: DataFrame, d: int, steps: int = STEPS, share: float = SHARE, shrink: float = SHRINK) -> DataFrame:
    """``g``, n, and the estimate of each group ``g`` of ``rows`` (g, its language ``p``, x0..), by concentration from
    two starts; a ``shrink`` of 0 leaves each group to itself."""
    xs = [f"x{i}" for i in range(d)]
    middle = [F.percentile_approx(f"x{i}", F.lit(0.5), F.lit(ACCURACY)).alias(f"c{i}") for i in range(d)]
    centres = materialise(rows.groupBy("g").agg(F.count("*").alias("size"), *middle), "centres")
    few = centres.count() <= BROADCAST_GROUPS
    with_ = lambda df, small: df.join(F.broadcast(small) if few else small, "g")
    near = with_(rows, centres)
    spread = [F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), F.lit(0.5), F.lit(ACCURACY)).alias(f"s{i}") for i in range(d)]
    spreads = materialise(near.groupBy("g").agg(*spread), "spreads")
    z = [f"abs(x{i} - c{i}) / (1.4826D * s{i} + {FLOOR!r}D)" for i in range(d)]
    was = [f"CAST(NULL AS DOUBLE) AS was_{k}" for k in (0, 1)]
    now = with_(near, spreads).selectExpr("g", "p", *xs, f"{' + '.join(f'power({x}, 2)' for x in z)} AS q0", f"greatest({', '.join(z)}) AS q1", *was)
    found, used = None, []
    for _ in range(steps):
        cut = [F.percentile_approx(f"q{k}", F.lit(share), F.lit(ACCURACY)).alias(f"cut{k}") for k in (0, 1)]
        cuts = materialise(now.groupBy("g").agg(*cut), "cuts")
        sums = materialise(_sums(with_(now, cuts), d), "sums")
        before, found = found, materialise(_estimates(sums, d, shrink), "estimates")
        discard(*used)
        used = [cuts, sums, before]
        moved = found.agg(F.expr("max(greatest(e0.was - e0.logdet, e1.was - e1.logdet))")).first()[0]
        if before is not None and (moved or 0.0) <= SETTLED:
            break
        now = with_(rows, found).select("g", "p", *xs, distance(d, "e0").alias("q0"), distance(d, "e1").alias("q1"), F.expr("e0.logdet AS was_0"), F.expr("e1.logdet AS was_1"))
    best = found.selectExpr("g", "CASE WHEN e1.logdet < e0.logdet THEN e1 ELSE e0 END AS _e")
    return centres.select("g", F.col("size").alias("n")).join(best, "g").select("g", "n", "_e.*").drop("was", "logdet")


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept."""
    d = len(VECTOR)
    named = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    counts = text_counts(named, id_col, text_col, ("_lang", "_source"))
    full = counts.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector())], _key(F.col("_lang"), F.col("_source")).alias("g"), _key(F.col("_lang")).alias("p"))
    full = materialise(full.drop("_lang", "_source", "n_distinct", "n_upper"), "counts")
    found = materialise(robust_estimates(full.select("g", "p", *[f"x{i}" for i in range(d)]), d), "robust").drop("n")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = full.join(F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found, "g")
    return judged.withColumn("distance2", distance(d)).withColumn("base_failed", failed).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2",
        (~F.col("base_failed") & (F.col("distance2") <= cutoff)).alias("kept"),
    )
