"""Field scorers: exact match with options, fuzzy match, cosine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.functions.json_text import bind, kind_of, kind_sql, list_items, object_entries

# Option names of the exact scorer, in the order they apply, and the
# characters each one removes. The dollar sign is removed at the start only.
REMOVALS = {
    "IGNORE_DOTS": ".",
    "IGNORE_COMMAS": ",",
    "IGNORE_DASHES": "-",
    "IGNORE_PARENTHETHES": "()",
}
LEADING_DOLLAR = "IGNORE_DOLLAR_SIGN"
ALSO_ACCEPTED = "ADDITIONAL_MATCHES"

# The fuzzy scorer's patterns as SQL text: letters it drops, what separates words, blanks.
LATIN, NOT_WORD, BLANKS = "[\\\\x{80}-\\\\x{ff}]", "(?U)\\\\W", "\\\\s+"

Scorer = Callable[[Column, Column, Column], Column]


def truthy(v: Column) -> Column:
    """Python truth of a VARIANT: the text "False" is on; '', 0, null and empty containers are off."""
    def decide(kind):
        return (
            F.when(kind == "string", F.try_variant_get(v, "$", "string") != "")
            .when(kind == "boolean", F.try_variant_get(v, "$", "boolean"))
            .when(kind == "number", F.try_variant_get(v, "$", "double") != 0)
            .when(kind.isin("object", "list"), ~F.to_json(v).isin("{}", "[]"))
        )

    return F.coalesce(bind(kind_of(v), decide), F.lit(False))


def options_of(config: Column, default: Mapping | None = None) -> Column:
    """Option map of a configuration VARIANT; an absent or empty one gives the default."""
    pairs = [x for name, value in (default or {}).items() for x in (F.lit(name), F.lit(value).cast("variant"))]
    fallback = F.create_map(*pairs) if pairs else F.lit(None)
    default_map = fallback.cast("map<string,variant>")
    return bind(object_entries(config), lambda given: F.when(F.size(given) > 0, given).otherwise(default_map))


def truthy_sql(v: str) -> str:
    """``truthy`` as SQL text."""
    get = lambda kind: f"try_variant_get({v}, '$', '{kind}')"
    return (
        f"coalesce(CASE {kind_sql(f'schema_of_variant({v})')} WHEN 'string' THEN {get('string')} <> '' WHEN 'boolean' THEN {get('boolean')} "
        f"WHEN 'number' THEN {get('double')} <> 0 WHEN 'object' THEN to_json({v}) <> '{{}}' WHEN 'list' THEN to_json({v}) <> '[]' END, FALSE)"
    )


def match_score_sql(gt: str, actual: str, options: str) -> str:
    """``match_score`` as SQL text; ``options`` is a map<string,variant>."""
    on = lambda name: truthy_sql(f"try_element_at({options}, '{name}')")
    removed = ", ".join(f"if({on(name)}, '{chars}', '')" for name, chars in REMOVALS.items())
    read = lambda text: f"trim(LEADING if({on(LEADING_DOLLAR)}, '$', '') FROM translate(lower({text}), concat({removed}), ''))"
    truth = read(f"coalesce({gt}, 'None')")
    also = f"try_variant_get(try_element_at({options}, '{ALSO_ACCEPTED}'), '$', 'array<variant>')"
    listed = f"transform(filter({also}, x -> schema_of_variant(x) = 'STRING'), x -> try_variant_get(x, '$', 'string'))"
    return f"coalesce(CAST({read(actual)} = {truth} OR coalesce(array_contains({listed}, {read(actual)}), FALSE) AS INT), 0)"


def fuzzy_score_sql(gt: str, actual: str, window: str = "window_percent") -> str:
    """``fuzzy_score`` as SQL text; ``window`` names the window search."""
    def tokens(text):
        latin = f"regexp_replace({text}, '{LATIN}', '')"
        words = f"split(trim(lower(regexp_replace({latin}, '{NOT_WORD}', ' '))), '{BLANKS}')"
        return f"array_sort(array_distinct(filter({words}, w -> w <> '')))"

    a, b = tokens(gt), tokens(actual)
    none = f"{gt} IS NULL OR {actual} IS NULL OR size({a}) = 0 OR size({b}) = 0"
    # settled pairs reach the search as nulls, which it skips
    side = lambda t: f"CASE WHEN NOT ({none} OR arrays_overlap({a}, {b})) THEN array_join({t}, ' ') END"
    return f"CASE WHEN {none} THEN 0.0D WHEN arrays_overlap({a}, {b}) THEN 1.0D ELSE {window}({side(a)}, {side(b)}) / 100.0D END"


def _is_on(options: Column, name: str) -> Column:
    return truthy(F.try_element_at(options, F.lit(name)))


def match_score(gt: Column, actual: Column, options: Column | Mapping) -> Column:
    """1 when the lower-cased texts are equal after the options' removals, else 0.

    A missing actual scores 0; a null ground truth reads "none". Accepted alternatives are
    compared as they are written. Options that are the same for all rows may be given as a mapping: they are then read
    once, here, and not row by row.
    """
    if isinstance(options, Mapping):
        removed = F.lit("".join(chars for name, chars in REMOVALS.items() if options.get(name)))
        dollar = F.lit("$" if options.get(LEADING_DOLLAR) else "")
        also = options.get(ALSO_ACCEPTED)
        texts = [x for x in also if isinstance(x, str)] if isinstance(also, list) else []
        listed = F.array(*map(F.lit, texts)) if texts else None
    else:
        removed = F.concat(*[F.when(_is_on(options, name), F.lit(chars)).otherwise(F.lit("")) for name, chars in REMOVALS.items()])
        dollar = F.when(_is_on(options, LEADING_DOLLAR), F.lit("$")).otherwise(F.lit(""))
        listed = F.transform(
            list_items(F.try_element_at(options, F.lit(ALSO_ACCEPTED))),
            lambda x: F.when(kind_of(x) == "string", F.try_variant_get(x, "$", "string")),
        )
    truth, found = [
        F.ltrim(F.call_function("translate", F.lower(c), removed, F.lit("")), dollar) for c in (F.coalesce(gt, F.lit("None")), actual)
    ]
    hit = found == truth
    if listed is not None:
        hit = hit | F.coalesce(F.array_contains(listed, found), F.lit(False))
    return F.coalesce(hit, F.lit(False)).cast("int")


def _tokens(text: Column) -> Column:
    """Sorted distinct words: Latin-1 letters above ASCII dropped, other symbols read as blanks."""
    latin = F.regexp_replace(text, "[\\x{80}-\\x{ff}]", "")
    words = F.trim(F.lower(F.regexp_replace(latin, r"(?U)\W", " ")))
    return F.array_sort(F.array_distinct(F.filter(F.split(words, r"\s+"), lambda w: w != "")))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per bit row."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _stretches(a: str, b: str) -> list[tuple[float, tuple[int, int]]]:
    """Stretches of ``b`` to compare with ``a``, each with a bound on its similarity, best first.

    All windows of a's length and all shorter prefixes and suffixes. The bound counts the
    letters both share, kept up while a window slides, so most stretches are never compared.
    """
    n, need, found = len(a), Counter(a), []
    for text, back in ((b, False), (b[::-1][: n - 1], True)):
        have, shared = Counter(), 0
        for i, ch in enumerate(text, 1):
            have[ch] += 1
            shared += have[ch] <= need[ch]
            if i > n:
                gone = text[i - n - 1]
                shared -= have[gone] <= need[gone]
                have[gone] -= 1
            lo = max(0, i - n)
            piece = (len(b) - i, len(b)) if back else (lo, i)
            found.append((2 * shared / (n + i - lo), piece))
    return sorted(found, reverse=True)


def best_window_percent(a: str, b: str) -> float:
    """Best similarity of the shorter text with any stretch of the longer one, 0 to 100.

    The similarity of two texts is 2·common/(len+len); equal lengths are searched both ways.
    """
    a, b = sorted((a, b), key=len)
    best = 0.0
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        for bound, (lo, hi) in _stretches(short, long):
            if bound <= best:
                break
            best = max(best, 2 * _common(short, long[lo:hi]) / (len(short) + hi - lo))
    return 100 * best


@F.pandas_udf(T.IntegerType())
def window_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], int] = {}

    def score(pair):
        if pair[0] is None or pair[1] is None:
            return None
        if pair not in seen:
            seen[pair] = round(best_window_percent(*pair))
        return seen[pair]

    return pd.Series([score(p) for p in zip(a, b)], dtype="Int32")


# A word character that survives the dropping of Latin-1 letters.
_WORD = r"(?U)[\w&&[^\x{80}-\x{ff}]]"


def _plain_score(gt: Column, actual: Column) -> Column:
    """The score where no words need to be read: a missing side, or equal texts."""
    return F.when(gt.isNull() | actual.isNull(), F.lit(0.0)).when(
        gt == actual, F.when(gt.rlike(_WORD), F.lit(1.0)).otherwise(F.lit(0.0))
    )


def _word_score(gt: Column, actual: Column) -> Column:
    """struct(score, a, b): the score where word sets decide, else the two texts to search."""

    def decide(t):
        a, b = t["a"], t["b"]
        empty = (F.size(a) <= 0) | (F.size(b) <= 0)
        score = F.when(empty, F.lit(0.0)).when(F.arrays_overlap(a, b), F.lit(1.0))
        search = score.isNull()
        return F.struct(
            score.alias("score"),
            F.when(search, F.array_join(a, " ")).alias("a"),
            F.when(search, F.array_join(b, " ")).alias("b"),
        )

    return bind(F.struct(_tokens(gt).alias("a"), _tokens(actual).alias("b")), decide)


def fuzzy_score(gt: Column, actual: Column, options: Column | None = None) -> Column:
    """Token-set partial ratio, 0 to 1.

    Words are compared as sets inside the JVM: a shared word scores 1, no words score 0.
    Only pairs of disjoint word sets go to Python for the window search.
    """
    plain = _plain_score(gt, actual)
    c = F.when(plain.isNull(), _word_score(gt, actual))
    return F.coalesce(plain, c["score"], window_percent(c["a"], c["b"]) / F.lit(100.0))


def with_fuzzy_score(df: DataFrame, out: str, gt: Column, actual: Column, options: Column | None = None) -> DataFrame:
    """``fuzzy_score`` as a new column, the words of each pair being read once."""
    plain, c = F.col("__plain"), F.col("__cmp")
    staged = df.withColumn("__plain", _plain_score(gt, actual)).withColumn(
        "__cmp", F.when(plain.isNull(), _word_score(gt, actual))
    )
    score = F.coalesce(plain, c["score"], window_percent(c["a"], c["b"]) / F.lit(100.0))
    return staged.withColumn(out, score).drop("__plain", "__cmp")


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null when one has no length."""
    zero = F.lit(0.0)

    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, zero, lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def text_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two texts.

    The words of both are sorted together; equal words of one side are a run, and a word of both sides is two
    neighbouring runs, so one pass over the runs gives products and lengths.
    """
    def tagged(text, side):
        words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
        return F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("s")))

    def runs_of(c):
        starts = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))
        return bind(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(c, p)["w"].alias("w"), F.get(c, p)["s"].alias("s"),
            (F.coalesce(F.get(at, k + 1), F.size(c)) - p).cast("double").alias("n"))))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def score(r):
        both = total(F.transform(r, lambda x, k: F.when(F.get(r, k - 1)["w"] == x["w"], x["n"] * F.get(r, k - 1)["n"]).otherwise(0.0)))

        def length(side):
            return F.sqrt(total(F.transform(r, lambda x: F.when(x["s"] == side, x["n"] * x["n"]).otherwise(0.0))))

        return bind(length(0) * length(1), lambda norm: F.when(norm > 0, both / norm))

    words = F.array_sort(F.concat(tagged(a, 0), tagged(b, 1)))
    return F.coalesce(bind(words, lambda c: F.when(F.size(c) > 0, bind(runs_of(c), score))), F.lit(0.0))
