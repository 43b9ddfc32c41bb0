"""Word lists and small column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query synonyms.
SYNONYMS = {
    "deliverables": ["objectives", "outcomes", "outputs", "milestones", "results"],
    "objectives": ["deliverables", "goals", "targets", "aims"],
    "goals": ["objectives", "targets", "aims", "outcomes"],
    "targets": ["goals", "objectives", "benchmarks", "milestones"],
    "revenue": ["income", "earnings", "sales", "turnover"],
    "income": ["revenue", "earnings", "profit"],
    "expenses": ["costs", "expenditure", "spending", "outlays"],
    "costs": ["expenses", "expenditure", "spending"],
    "profit": ["earnings", "income", "net income", "margin"],
    "strategy": ["plan", "approach", "roadmap", "framework"],
    "plan": ["strategy", "roadmap", "blueprint", "proposal"],
    "risks": ["threats", "challenges", "issues", "vulnerabilities"],
    "challenges": ["risks", "issues", "obstacles", "problems"],
    "stakeholders": ["partners", "participants", "collaborators"],
    "requirements": ["specifications", "criteria", "needs"],
    "specifications": ["requirements", "specs", "criteria"],
    "timeline": ["schedule", "milestones", "deadlines", "timeframe"],
    "schedule": ["timeline", "timetable", "deadlines"],
    "budget": ["funding", "allocation", "financial plan", "costs"],
    "performance": ["results", "metrics", "outcomes", "kpis"],
    "metrics": ["kpis", "measures", "indicators", "benchmarks"],
    "recommendations": ["suggestions", "proposals", "actions"],
    "findings": ["results", "conclusions", "outcomes", "observations"],
    "scope": ["coverage", "extent", "boundaries", "range"],
    "compliance": ["adherence", "conformance", "regulatory"],
    "assessment": ["evaluation", "analysis", "review", "appraisal"],
    "evaluation": ["assessment", "analysis", "review", "appraisal"],
}


#: Spark's own English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's
it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's
when's where's who's why's would
""".split()


def stop_words() -> tuple[str, ...]:
    return tuple(sorted(set(STOP_WORDS)))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def ascii_words(text: Column | str, stops: tuple[str, ...] | None = None) -> Column:
    """Lower-case tokens of three or more ASCII letters and nothing else, stop words out."""
    stops = stop_words() if stops is None else stops
    return F.filter(tokens(text), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*stops))


def exact_sum(c: Column) -> Column:
    """A sum of doubles that does not depend on the order of its rows."""
    return F.sum(c.cast("decimal(28,10)")).cast("double")


def score_sum(c: Column) -> Column:
    """The same for scores of up to 1e8: ten decimals of each, summed as whole numbers."""
    return F.sum(F.rint(c * 1e10).cast("long")).cast("double") / F.lit(1e10)


def ranked(keys: list[str], *order: Column):
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
