"""What each flag means, in a sentence."""

from __future__ import annotations

from plumbline.operators import flags as G

MEANING = {
    "missing": f"Some values are missing; above {G.MISSING_BAD} % of the rows it is severe.",
    "infinite": "Some values are infinite; the statistics leave them out.",
    "negatives": f"Some values are below zero; a warning above {G.NEGATIVE_WARN} %.",
    "zero_inflated": f"At least {G.ZERO_WARN} % of the values are zero; from {G.ZERO_BAD} % on it is severe.",
    "positive_only": "All values are above zero.",
    "skewed_right": "The long tail is on the side of large values.",
    "skewed_left": "The long tail is on the side of small values.",
    "log_scale": "All values are above zero and the long tail is on the right, so a logarithmic scale shows more.",
    "heavy_tailed": "Extreme values are more frequent, or rarer, than in a normal distribution.",
    "normal": "Skew and kurtosis don't speak against a normal distribution.",
    "discrete": f"Whole numbers with at most {G.DISCRETE_LEVELS} different values.",
    "heaping": f"At least {G.HEAPING} % of the values are round numbers.",
    "constant": "All values are the same.",
    "quasi_constant": "Nearly all values are the same, or there are only two.",
    "many_outliers": f"More than {G.MANY_OUTLIERS} % of the values lie outside the quartile fences.",
    "some_outliers": f"Between {G.SOME_OUTLIERS} % and {G.MANY_OUTLIERS} % of the values lie outside the quartile fences.",
    "monotonic_increasing": "No value is below the one before it.",
    "monotonic_decreasing": "No value is above the one before it.",
    "high_cardinality": "There are many different values for the number of rows.",
    "dominant": "One value stands in at least 70 % of the rows.",
    "case_variants": "Some values differ in nothing but the case of letters.",
    "trim_variants": "Some values differ in nothing but blanks around them.",
    "empty_values": "Some texts are empty or zero.",
    "imbalanced": "One of the two values is very rare.",
    "weekend_heavy": "More of the times fall on weekends than days of the week explain.",
    "business_hours": "Most of the times fall into business hours.",
    "mostly_unique": "Hardly any time occurs twice.",
    "irregular": "The gaps between neighbouring times differ widely.",
    "seasonal": "Some months have clearly more times than others.",
}


def meanings(flags: list[dict]) -> list[tuple[str, str]]:
    """(flag, meaning) of the flags that are raised, by name."""
    return [(name.replace("_", " "), MEANING.get(name, "")) for name in sorted({f["flag"] for f in flags})]
