"""Heading shapes and heading-to-role rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let

HEADING_MAX = 110
# Headings known by name.
KNOWN_HEADING = (
    "(?i)^(?:abstract|introduction|background|related work|literature review|method(?:ology)?|"
    "materials and methods|approach|model|system design|implementation|experiment(?:s|al setup)?|evaluation|"
    "validation|results?|findings|discussion|limitations?|conclusions?|future work|acknowledg(?:e)?ments?|"
    "references|bibliography)$"
)
# Ordered rules from heading wording to (title, role).
HEADING_RULES = [
    ("abstract|executive summary", "abstract", "abstract"),
    ("introduction|overview", "introduction", "background"),
    ("related work|literature review|prior work", "related_work", "background"),
    ("background|foundation|theory|bayesian network", "background", "background"),
    ("method|approach|model|modelling|architecture|design", "methodology", "method"),
    ("implementation|application methodology|toolset", "methodology", "implementation"),
    ("experiment|evaluation|validation|trial|aim and methodology", "experiments", "evaluation"),
    ("result|finding|performance", "results", "results"),
    ("discussion|analysis|limitation", "discussion", "discussion"),
    ("conclusion|summary", "conclusion", "conclusion"),
    ("future work|future research", "future_work", "conclusion"),
    ("acknowledg", "acknowledgements", "other"),
    ("reference|bibliography", "references", "references"),
]
# Ordered rules from section heading to the role claims look at.
ROLE_RULES = [
    ("abstract", "abstract"),
    ("method|model|approach|modelling", "method"),
    ("implementation|toolset|application", "implementation"),
    ("experiment|evaluation|validation|trial", "evaluation"),
    ("result|finding", "results"),
    ("discussion|limitation", "discussion"),
    ("conclusion|future", "conclusion"),
]
NUMBERED = r"^([0-9]+(?:\.[0-9]+)*)[.)]?" + T.WS_LIST + "+(.+)$"


def _words(text: Column) -> Column:
    return F.split(text, T.WS + "+")


def heading_like(text: Column) -> Column:
    """Wording after a section number that can be a heading."""
    n = F.size(_words(T.strip(text)))
    return (n <= 14) & ~(text.rlike(r"[.!?]$") & (n > 7)) & text.rlike("[A-Za-z]")


def is_known(text: Column) -> Column:
    return text.rlike(KNOWN_HEADING)


def is_upper(text: Column) -> Column:
    letters = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Za-z]+", ""))
    return (letters >= 3) & (text == F.upper(text)) & (F.size(_words(text)) <= 12)


def is_title_case(text: Column) -> Column:
    def test(w: Column) -> Column:
        capital = F.size(F.filter(w, lambda x: x.rlike("^[A-Z][A-Za-z0-9&/-]*$")))
        return (F.size(w) <= 10) & (capital / F.size(w) >= 0.75) & ~text.rlike(r"[.!?]$")

    return let(_words(text), test)


def heading_number(text: Column) -> Column:
    """Section number of a numbered heading, else null."""
    number = F.regexp_extract(text, NUMBERED, 1)
    return F.when((number != "") & heading_like(F.regexp_extract(text, NUMBERED, 2)), number)


def heading_of(line: Column) -> Column:
    """Heading struct<line, heading, number, level> of a line, or null."""

    def shape(t: Column) -> Column:
        number = heading_number(t)
        return F.when(
            (t != "") & (F.char_length(t) <= HEADING_MAX),
            F.when(
                number.isNotNull(),
                F.struct(
                    line.alias("line"), T.strip(F.regexp_extract(t, NUMBERED, 2)).alias("heading"), number.alias("number"),
                    F.size(F.split(number, r"\.")).alias("level"),
                ),
            ).when(
                is_known(t) | is_upper(t) | is_title_case(t),
                F.struct(
                    line.alias("line"), t.alias("heading"), F.lit(None).cast("string").alias("number"), F.lit(1).alias("level")
                ),
            ),
        )

    return let(T.strip(line), shape)


def map_heading(heading: Column) -> Column:
    """(title, role) of a heading by the first rule that fits."""

    def rule(value: Column) -> Column:
        title, role = None, None
        for pattern, t, r in HEADING_RULES:
            test = value.rlike(pattern)
            title = F.when(test, t) if title is None else title.when(test, t)
            role = F.when(test, r) if role is None else role.when(test, r)
        return F.struct(title.otherwise("other").alias("title"), role.otherwise("other").alias("role"))

    return let(T.squeeze_strip(F.regexp_replace(F.lower(heading), r"[^a-z0-9]", " ")), rule)


def section_role(heading: Column) -> Column:
    low = F.lower(heading)
    role = None
    for pattern, name in ROLE_RULES:
        test = low.rlike(pattern)
        role = F.when(test, name) if role is None else role.when(test, name)
    return role.otherwise("background")
