"""Which operator does a question ask for, and which columns does it mean?  Scored evidence that may abstain.

Each operator has signals, words of a question that speak for it, with weights.  What a question rules out
("not the mean", "rather than ...") is taken away first.  The operator with the highest sum is meant, if
the sum is at least ``LEAST`` and the next one is ``MARGIN`` behind; else the question is left open.
The same table serves one prompt and a column of prompts; a prompt without any of the signals' words is
not looked at closer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MARGIN = 2, 1
#: Phrases that a question rules out, up to the end of the phrase.
RULED_OUT = r"\b(?:not|never|rather than|instead of) (?!drop|double|inflat)[^,;.()]*"
_NUMBER = r"(?:[0-9]+|two|three|four|five|ten)"
_ABSENT = r"(?:missing|null|nan|absent|blank|unknown|empty)"

#: Operator: (weight, signal).  Alternations and classes only, so that any regex engine reads them alike.
SIGNALS: dict[str, list[tuple[int, str]]] = {
    "weighted_mean": [(3, r"weighted|weigh(?:t|ing) (?:each|every|them|it)"), (1, r"\b(?:mean|average)\b"), (2, r"per unit sold")],
    "within_group_share": [(3, r"\bown [a-z_]+(?:'s|s')? (?:total|sum)"), (2, r"\bshare (?:of|within|in)\b|within[- ][a-z_]+ share"), (2, r"(?:fraction|percent|percentage|part) of (?:its|the|their|his|her) (?:[a-z_]+ )?(?:group|total|sum)")],
    "pct_point": [(4, r"percentage[- ]points?|\bpp\b"), (1, r"change (?:in|from)")],
    "dedup_then_agg": [(3, r"\bonly once|(?:each|every) [a-z_]+ (?:just |exactly )?once"), (2, r"dedup|duplicated?\b"), (2, r"distinct (?:orders|ids|keys|records)")],
    "left_join_keep_all": [(3, r"keep(?:ing)? (?:all|every|each) (?:the |of the )?(?:rows?|records?|customers?|left)"), (3, r"left join|including those without"), (2, r"no match|unmatched|without a match"), (1, r"attach|look up")],
    "pooled_rate": [(3, r"pooled|overall rate|ratio of (?:the )?totals"), (3, r"total [a-z_]+ ?(?:/|over|divided by) ?(?:the )?total"), (2, r"click[- ]through|\bctr\b")],
    "median_not_mean": [(3, r"median"), (2, r"\btypical|middle value")],
    "cumulative_running": [(3, r"cumulative|cumulated|running \(?(?:total|sum|balance|cumulative)"), (2, r"so far|up to (?:and including )?(?:each|that) (?:day|date|row)")],
    "topn_with_ties": [(3, r"\btop[- ]?" + _NUMBER), (2, r"\bties\b")],
    "nan_as_zero_sum": [(4, _ABSENT + r"(?: values?| cells?| entries)?\b[^.]{0,12} (?:as|to|with|for|be) (?:a )?(?:0|zeros?)\b"), (3, r"(?:0|zero) (?:for|where|in place of) " + _ABSENT)],
    "count_includes_empty": [(4, r"(?:including|include|also|even) [a-z ]{0,20}(?:empty|zero|no) ?(?:ones|rows|counts|records|entries)?"), (2, r"(?:every|all|each) (?:possible )?categor|zero counts?"), (1, r"\bcategor")],
    "proportion_true": [(3, r"(?:proportion|fraction|percentage|share) (?:of|that)\b[^.]{0,30}\b(?:true|pass|passed|passing|flag|flagged|succeed|succeeded|yes)\b"), (3, r"pass[_ ]rate|success rate"), (1, r"proportion|fraction")],
    "zscore_within_group": [(3, r"z[- ]?scores?"), (2, r"standardi[sz]ed? within|within (?:each|its|every) [a-z_]+"), (1, r"own (?:mean|std|average)")],
    "dense_rank": [(4, r"\bdense"), (3, r"(?:no|without) gaps"), (1, r"\brank")],
    "cumcount_per_group": [(4, r"running count|occurrence number|sequence number"), (2, r"\b(?:nth|resets?|restarts?)\b|number each"), (1, r"occurrence")],
    "rank_pct": [(4, r"percentiles?\b"), (1, r"\brank")],
    "clip_outlier": [(4, r"\bclip|winsor|\bclamp"), (3, r"\bcap(?:ped|ping)?\b"), (2, r"\b(?:limit|restrict|bound)\b[^.]* (?:to|between) (?:the )?(?:range|-?[0-9])")],
    "index_align": [(4, r"\balign"), (4, r"match(?:ed|ing)? by (?:the )?(?:id|key)\b|for the same (?:id|key)\b")],
    "dtype_coerce": [(4, r"leading zeros?"), (3, r"\bas (?:a )?(?:text|string)\b|stays? (?:a )?(?:text|string)")],
    "groupby_dropna_key": [(4, _ABSENT + r"[^.]{0,16} (?:as )?(?:their|its|an?) own (?:group|category|row)"), (4, _ABSENT + r"(?: or [a-z]+)? (?:group|key|categor|label)")],
    "order_dependent_dedup": [(4, r"most recent|\blatest\b|\bnewest\b"), (4, r"(?:maximum|max|largest|highest|greatest) (?:ts|time|timestamp|date|version)\b"), (1, r"(?:for each|one row per|per) (?:id|key)")],
    "resample_boundary": [(4, r"resampl|right[- ]closed|time bins"), (3, r"hourly (?:bins|totals|sums)")],
    "string_normalize_join": [(4, r"(?:case|white ?space)[- ][a-z -]{0,20}insensitiv|ignor(?:e|es|ing) (?:case|white|capital)"), (3, r"\bstrip(?:ped|ping)?\b|\btrim(?:med|ming)?\b|lower-?case both")],
    "join_fanout": [(4, r"fan(?:ning|s|ned)?[- ]?out|double[- ]count"), (3, r"inflat"), (2, r"several rows per")],
    "null_in_agg_count": [(3, r"number of (?:rows|records)|how many (?:rows|records)|count (?:of )?(?:all|every) (?:the )?(?:rows|records)"), (3, r"group sizes?\b")],
    "scale_before_split_leakage": [(4, r"(?:fit|fitted|scal[a-z]+|standardi[sz][a-z]+|mean)\b[^.]{0,60}\btrain(?:ing)?\b"), (1, r"standardi[sz]|scal(?:e|ed|ing)")],
    "lookahead_return": [(4, r"\[ ?t ?- ?1 ?\]|returns? (?:from|over|against|on) the (?:previous|prior)"), (3, r"daily returns?|period(?:-over-period)? returns?"), (2, r"past prices?"), (1, r"\breturns?\b")],
    "latlon_swap": [(4, r"latitude|longitude"), (3, r"\bcoordinates?\b|\blat\b[^.]*\blon")],
    "array_difference": [(4, r"element[- ]?wise|element by element"), (2, r"\b(?:arrays?|vectors?)\b"), (1, r"difference|subtract")],
}

_COMPILED = {op: [(w, re.compile(p)) for w, p in signals] for op, signals in SIGNALS.items()}
_ANY = "|".join(f"(?:{p})" for signals in SIGNALS.values() for _, p in signals)
_ANY_COMPILED, _RULED_OUT = re.compile(_ANY), re.compile(RULED_OUT)
_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "ten": 10}


def evidence(prompt: str) -> dict[str, int]:
    """The sum of signals of each operator that has one."""
    text = _RULED_OUT.sub(" ", prompt.lower())
    if not _ANY_COMPILED.search(text):
        return {}
    sums = {op: sum(w for w, p in signals if p.search(text)) for op, signals in _COMPILED.items()}
    return {op: n for op, n in sums.items() if n}


def infer_operator(prompt: str) -> str | None:
    found = sorted(evidence(prompt).items(), key=lambda x: -x[1])
    if not found or found[0][1] < LEAST or (len(found) > 1 and found[0][1] - found[1][1] < MARGIN):
        return None
    return found[0][0]


def operator_column(prompt: Column) -> Column:
    """The same over a column of prompts; NULL where the question is left open."""
    text = F.regexp_replace(F.lower(prompt), RULED_OUT, " ")
    sums = [F.struct(sum((F.when(text.rlike(p), w).otherwise(0) for w, p in signals), F.lit(0)).alias("n"), F.lit(op).alias("op")) for op, signals in SIGNALS.items()]
    ranked = F.when(text.rlike(_ANY), F.sort_array(F.array(*sums), asc=False))
    pick = lambda x: F.when((x[0]["n"] >= LEAST) & (x[0]["n"] - x[1]["n"] >= MARGIN), x[0]["op"])
    # The sorted sums are named once, by a transform of one element, as the expression would be repeated otherwise.
    return F.transform(F.array(ranked), pick)[0]


def roles(df: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"num": [], "cat": [], "bool": [], "time": []}
    for c, t in df.dtypes:
        kind = "bool" if t == "boolean" else "num" if t in ("bigint", "int", "double", "float", "smallint") or t.startswith("decimal") else "time" if t.startswith(("timestamp", "date")) else "cat"
        out[kind].append(c)
    return out


def infer_params(op: str, df: DataFrame, prompt: str) -> dict[str, object]:
    """Roles filled by type and name; the output's name is what stands in quotes."""
    r, text = roles(df), prompt.lower()
    num, cat = r["num"], r["cat"]
    ids = [c for c in df.columns if "id" in c.lower()]
    measures = [c for c in num if c not in ids] or num
    found: dict[str, object] = {}
    if cat:
        found["group"] = found["category"] = cat[0]
    if measures:
        found["value"] = found["measure"] = found["feature"] = found["price"] = measures[-1]
        found["order"] = [*r["time"], *[c for c in num if c != measures[-1]], *cat][:2] or [measures[-1]]
    if len(measures) > 1:
        found |= {"num": measures[0], "den": measures[1], "old": measures[0], "new": measures[1]}
    if op == "weighted_mean" and len(measures) > 1:
        found |= {"value": measures[0], "weight": measures[1]}
    if r["bool"]:
        found["flag"] = r["bool"][0]
    if ids:
        found["key"] = found["id_col"] = ids[0]
    if r["time"]:
        found["time"] = r["time"][0]
    if m := re.search(r"top[- ]?(\d+|two|three|four|five|ten)", text):
        found["n"] = _WORDS.get(m[1]) or int(m[1])
    numbers = [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", text)]
    if len(numbers) >= 2:
        found |= {"lo": numbers[0], "hi": numbers[1]}
    if m := re.search(r"[\"']([A-Za-z_]\w*)[\"']", prompt):
        found["out"] = m[1]
    return found


def infer_from_schema(df: DataFrame, prompt: str) -> str | None:
    """Where no rule fits but a total is asked for: an id column asks for one row each, missing numbers for zeros."""
    if not re.search(r"total|sum", prompt.lower()):
        return None
    if any("id" in c.lower() for c in df.columns):
        return "dedup_then_agg"
    num = roles(df)["num"]
    if num and not df.filter(" or ".join(f"`{c}` is null" for c in num)).isEmpty():
        return "nan_as_zero_sum"
    return None


def infer(df: DataFrame, prompt: str) -> tuple[str | None, dict[str, object]]:
    op = infer_operator(prompt) or infer_from_schema(df, prompt)
    return op, infer_params(op, df, prompt) if op else {}
