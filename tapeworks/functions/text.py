"""Headline normalisation and event typing, as JVM regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Event categories and their patterns in priority order (the first match decides).
EVENT_PATTERNS = (
    (
        "earnings",
        r"\bearnings\b|\bquarterly (results|report)\b|\bq[1-4]\s+(results|revenue|earnings)"
        r"|\b(beats?|missed?|misses|tops?)\s+(estimates|expectations|wall street)"
        r"|\beps\b|\brevenue (rose|fell|beat|jumped|grew|declined)",
    ),
    (
        "guidance",
        r"\bguidance\b|\boutlook\b|\b(raises?|cuts?|lowers?|lifts?|slashes)\s+"
        r"(full[- ]year|annual|quarterly|its)?\s*(forecast|outlook|guidance|view)",
    ),
    (
        "mna",
        r"\bmergers?\b|\bacquisitions?\b|\bacquires?\b|\btakeover\b|\bbuyout\b"
        r"|\bto buy\b|\bdeal to acquire\b|\bgoing private\b|\btender offer\b",
    ),
    (
        "clinical",
        r"\bfda\b|\bclinical trial\b|\bphase\s+(1|2|3|i{1,3})\b|\bdrug approval\b"
        r"|\bbreakthrough therapy\b|\bnda\b|\bbiologics license\b",
    ),
    (
        "regulatory_legal",
        r"\blawsuits?\b|\bsue[sd]?\b|\bsettlements?\b|\bprobes?\b|\binvestigations?\b"
        r"|\bsec charges\b|\bantitrust\b|\bfined\b|\bcourt rul|\bregulators?\b|\bdoj\b",
    ),
    (
        "management",
        r"\b(ceo|cfo|coo|chairman|executive|president)\b.*\b(resigns?|steps? down|departs?|"
        r"appoints?|names?|hires?|fires?|ousts?|retires?)\b"
        r"|\b(resigns?|steps? down|appoints?|names?)\b.*\b(ceo|cfo|coo|chairman)\b",
    ),
    (
        "financing",
        r"\bshare (offering|repurchase|buyback)\b|\bbuybacks?\b|\bdividends?\b"
        r"|\bsecondary offering\b|\bnotes offering\b|\bconvertible\b|\bdilut"
        r"|\bipo\b|\bstock split\b|\bcapital raise\b",
    ),
    (
        "analyst",
        r"\bupgrades?d?\b|\bdowngrades?d?\b|\bprice target\b|\binitiates coverage\b"
        r"|\boverweight\b|\bunderweight\b|\bbuy rating\b|\bsell rating\b|\banalysts?\b",
    ),
    (
        "product",
        r"\blaunch(es|ed)?\b|\bunveil(s|ed)?\b|\brecalls?\b|\bnew product\b"
        r"|\bannounces? new\b|\bintroduc(es|ed|ing)\b",
    ),
    (
        "partnership",
        r"\bpartnerships?\b|\bcollaborations?\b|\bwins (deal|contract)\b"
        r"|\bcontract (win|award)\b|\bawarded\b|\bsigns? (deal|agreement)\b|\bjoint venture\b",
    ),
    (
        "macro",
        r"\bfed\b|\bfederal reserve\b|\binflation\b|\bcpi\b|\bjobs report\b|\bpayrolls\b"
        r"|\btariffs?\b|\binterest rates?\b|\btreasury yields?\b|\brecession\b|\bgdp\b",
    ),
)
# Each match of a category's pattern holds one of its strings, so the pattern need not run on other texts.
EVENT_HINTS = {
    "earnings": ("earnings", "results", "quarterly report", "estimates", "expectations", "wall street", "eps", "revenue"),
    "guidance": ("guidance", "outlook", "forecast", "view"),
    "mna": ("merger", "acqui", "takeover", "buyout", "to buy", "going private", "tender offer"),
    "clinical": ("fda", "clinical trial", "phase", "drug approval", "breakthrough therapy", "nda", "biologics license"),
    "regulatory_legal": (
        "lawsuit", "sue", "settlement", "probe", "investigation", "sec charges", "antitrust", "fined", "court rul", "regulator", "doj",
    ),
    "management": ("ceo", "cfo", "coo", "chairman", "executive", "president"),
    "financing": ("offering", "repurchase", "buyback", "dividend", "convertible", "dilut", "ipo", "stock split", "capital raise"),
    "analyst": ("grade", "price target", "initiates coverage", "erweight", "rating", "analyst"),
    "product": ("launch", "unveil", "recall", "new product", "announce new", "announces new", "introduc"),
    "partnership": ("partnership", "collaboration", "contract", "award", " deal", "agreement", "joint venture"),
    "macro": (
        "fed", "inflation", "cpi", "jobs report", "payrolls", "tariff", "interest rate", "treasury yield", "recession", "gdp",
    ),
}
FEATURED_EVENTS = ("earnings", "guidance", "mna", "clinical", "regulatory_legal", "analyst")
SENTIMENT_VALUES = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}

# Case-blind, Unicode word boundaries, and a dot that stops at line feeds only. Every alternative above opens with a
# word boundary, so testing it once up front skips the positions inside words without changing what matches.
_RULE = r"(?idU)\b(?:{})"
# Letters beyond A-Z that a case-blind pattern takes for one of a-z.
_LOOKALIKES = {"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"}


def folded(text: Column) -> Column:
    """Lower case, in which a string of a-z occurs wherever a case-blind pattern finds it."""
    return F.lower(reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _LOOKALIKES.items(), text))


def normalize_title(title: Column) -> Column:
    """Lower-case alphanumeric tokens joined by single spaces; a missing title gives the empty string."""
    tokens = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def classify_event(title: Column, description: Column | None = None) -> Column:
    """First matching category over title and description, 'other' when none match.

    A pattern takes far longer over a text than a search for a few strings, so it runs only where one of its hints occurs.
    """
    empty = F.lit("")
    text = F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(description, empty) if description is not None else empty)

    def first_match(both: Column) -> Column:
        found = {n: reduce(Column.__or__, [F.contains(both["folded"], F.lit(h)) for h in hints]) for n, hints in EVENT_HINTS.items()}
        return F.coalesce(*[F.when(found[n] & both["text"].rlike(_RULE.format(p)), F.lit(n)) for n, p in EVENT_PATTERNS], F.lit("other"))

    # The text is put together and folded once, as the element of an array.
    each = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), folded(t).alias("folded")))
    return F.get(F.transform(each, first_match), F.lit(0))


def sentiment_value(sentiment: Column) -> Column:
    """+1 / -1 / 0 for a known sentiment, NULL otherwise (absent is not neutral)."""
    return reduce(
        lambda chain, item: chain.when(sentiment == item[0], F.lit(item[1])),
        SENTIMENT_VALUES.items(),
        F.when(F.lit(False), F.lit(None).cast("double")),
    )
