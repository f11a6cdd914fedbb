"""Free-text requests to constraint columns: native column expressions, but for long lists of names to look for."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import fixed


#: Most domains tested one by one against a text.
MAX_LISTED_DOMAINS = 1_000
#: Most bytes of domain names that go into one automaton in every task.
MAX_AUTOMATON_BYTES = 16 << 20


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return _group(text, pattern, group).try_cast("bigint")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _clean(items: Column) -> Column:
    trimmed = F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def parse_basic(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``exp_op`` (less/more), ``exp_years`` and ``budget``: the first match of each."""
    low = F.lower(text)
    return df.withColumns({
        "exp_op": _group(low, fixed.EXPERIENCE_PATTERN, 1),
        "exp_years": _number(low, fixed.EXPERIENCE_PATTERN, 2),
        "budget": _number(low, fixed.BUDGET_PATTERN),
    })


def domains_in_order(catalog: DataFrame, domain: str = "domain", id_col: str = "item_id") -> DataFrame:
    """Distinct domains with the first id each appears at."""
    return catalog.groupBy(domain).agg(F.min(id_col).alias("first_id"))


def _first_name(names: list[str | None], lower: list[str]):
    """A pandas UDF from a text in lower case to the first of ``names`` that it contains: one pass over the text through
    an automaton of all names, whatever their number. It is built once per task."""

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, always = ahocorasick.Automaton(), None
        for place in reversed(range(len(lower))):  # of equal names the first stays
            if lower[place]:
                automaton.add_word(lower[place], place)
            else:
                always = place  # every text contains the empty name
        some = len(automaton) > 0
        automaton.make_automaton()

        def first(text: str | None) -> str | None:
            if text is None:
                return None
            places = [] if always is None else [always]
            if some:
                places += [place for _, place in automaton.iter(text)]
            return names[min(places)] if places else None

        for batch in batches:
            yield batch.map(first)

    return found


def detect_domain(
    df: DataFrame, catalog: DataFrame, text: str = "text", max_listed: int = MAX_LISTED_DOMAINS, max_bytes: int = MAX_AUTOMATON_BYTES
) -> DataFrame:
    """Add ``domain``: the first one, in catalog order, that the text contains.

    A short vocabulary is tested as a list. A longer one, while its names fit ``max_bytes``, becomes an automaton that reads
    each text once. Beyond that it is joined on equality: each text is cut into all pieces as long as some domain, so that
    no text meets every domain.
    """
    firsts = domains_in_order(catalog.where(F.col("domain").isNotNull()))
    head = firsts.orderBy("first_id").limit(max_listed + 1).collect()
    if not head:
        return df.withColumn("domain", F.lit(None).cast("string"))
    if len(head) <= max_listed:
        names = F.array(*[F.lit(r["domain"]) for r in head])
        return df.withColumn("domain", F.get(F.filter(names, lambda d: F.contains(F.lower(text), F.lower(d))), F.lit(0)))
    if (firsts.agg(F.sum(F.octet_length("domain"))).first()[0] or 0) <= max_bytes:
        rows = firsts.orderBy("first_id").select("domain", F.lower("domain").alias("low")).collect()  # of checked size
        return df.withColumn("domain", _first_name([r.domain for r in rows], [r.low for r in rows])(F.lower(text)))
    known = firsts.withColumn("_piece", F.lower("domain"))
    lengths = F.array(*[F.lit(r[0]) for r in known.select(F.length("_piece")).distinct().collect()])  # a few word lengths
    texts = df.select(F.col(text).alias("_text")).distinct().withColumn("_low", F.lower("_text"))
    fitting = F.filter(lengths, lambda n: n <= F.length("_low"))
    places = texts.withColumn("_n", F.explode(fitting)).withColumn("_at", F.explode(F.expr("sequence(1, length(_low) - _n + 1)")))
    pieces = places.select("_text", F.expr("substring(_low, _at, _n)").alias("_piece")).distinct()
    found = pieces.join(known, "_piece").groupBy("_text").agg(F.min_by("domain", "first_id").alias("domain"))
    return df.join(found, F.col(text) == F.col("_text"), "left").drop("_text")


def normalise_aliases(text: Column, aliases: Mapping[str, str] = fixed.SPECIALTY_ALIASES) -> Column:
    """Apply every replacement in the mapping's order."""
    for alias, name in aliases.items():
        text = F.replace(text, F.lit(alias), F.lit(name))
    return text


def parse_bounds(df: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Add experience bounds, places and specialties, after alias replacement.

    With ``strict`` "at least 5 years" asks for more than 5, like "more than"; otherwise for 5.
    A place after "not in" is both excluded and taken as the wanted place.
    """
    t = normalise_aliases(F.col(text))
    least = _number(t, fixed.MIN_YEARS_PATTERN)
    if strict:
        min_exp = least + 1
    else:
        more = F.regexp_extract(t, r"(?i)(more than|at least|min(?:imum)?) [0-9]+ years?", 1)
        min_exp = F.when(F.lower(more) == "more than", least + 1).otherwise(least)
    return df.withColumns({
        "min_exp": min_exp,
        "max_exp": _number(t, fixed.MAX_YEARS_PATTERN) - 1,
        "excluded_places": _all(t, fixed.EXCLUDED_PLACE_PATTERN),
        "required_spec": F.trim(_group(t, fixed.REQUIRED_SPECIALTY_PATTERN)),
        "excluded_specs": _all(t, fixed.EXCLUDED_SPECIALTY_PATTERN),
        "place": _group(t, fixed.PLACE_PATTERN),
        "wanted_specs": _all(t, fixed.WANTED_SPECIALTY_PATTERN),
    })


def parse_full(df: DataFrame, text: str = "text", cities: Sequence[str] = fixed.CITIES) -> DataFrame:
    """Add ``min_exp``, ``max_exp``, ``exact_exp`` and include/exclude lists of cities and specialties.

    "more than" and "less than" override the bounds of "between". Lists are cut at "or" and "and"
    only where these stand as words.
    """
    t = F.lower(text)
    # Longer names first, so that a name that begins another one does not cut it.
    names = "|".join(sorted(cities, key=len, reverse=True))
    block = rf"(?:in|from|not in|not) (?:{names})(?:\s*(?:and|,)\s*(?:{names}))*"
    blocks = _all(t, block, 0)

    def listed(groups: Column) -> Column:
        cut = F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"^(?:not in|not|in|from) ", ""), r"\s*,\s*|\s+and\s+"))
        return _clean(F.flatten(cut))

    specs = F.regexp_replace(F.regexp_extract(t, fixed.INCLUDE_SPECIALTY_PATTERN, 1), "not in .*", "")
    excluded = F.concat(*[_all(t, p) for p in fixed.EXCLUDE_SPECIALTY_PATTERNS])
    return df.withColumns({
        "min_exp": F.coalesce(_number(t, fixed.MORE_THAN_PATTERN) + 1, _number(t, fixed.BETWEEN_PATTERN, 1)),
        "max_exp": F.coalesce(_number(t, fixed.LESS_THAN_PATTERN) - 1, _number(t, fixed.BETWEEN_PATTERN, 2)),
        "exact_exp": _number(t, fixed.ONLY_YEARS_PATTERN),
        "include_cities": listed(F.filter(blocks, lambda b: ~b.startswith("not"))),
        "exclude_cities": listed(F.filter(blocks, lambda b: b.startswith("not"))),
        "include_specs": _clean(F.split(specs, r"\s+or\s+")),
        "exclude_specs": _clean(excluded),
    })
