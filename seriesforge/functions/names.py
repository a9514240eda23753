"""Names of targets brought to one key by rules that only look at the text, each noted when it changes something."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesforge.functions.scalars import col

#: Words that stand for filters and grisms, months of an observer's mark, spellings of the last word, keys of one target.
FILTERS = "hrg lrg ha og hagrism oggrism lum red green blue empty g r i u b v l w o h x y z 6 1".split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
GENITIVES = {"lyrae": "lyr"}
SYNONYMS = {"alphalyr": "vega", "ngc5457": "m101", "pinwheelgalaxy": "m101", "2023ixf1": "2023ixf", "2023ixf2": "2023ixf"}
EXPOSURE = r"\d+(?:[-p]\d+)?s"
#: A run of exposures, filters and counters at the end; a name is left before it.
TAIL = rf"(?i)^(.+?)((?: (?:{EXPOSURE}|{'|'.join(FILTERS)}|\d{{1,2}}))+)$"
#: In order; the blank rule and the synonyms stand apart.
RULES = ("whitespace", "prefix_junk", "observer_prefix", "series_suffix", "exposure_tokens", "genitive", "casefold", "separators")


def steps(raw) -> list[Column]:
    """The text before all rules and after each of them, but for the synonyms."""
    text = [col(raw).cast("string")]
    add = text.append
    add(F.trim(F.regexp_replace(text[-1], r"(?U)\s+", " ")))
    add(F.regexp_replace(text[-1], r"(?i)^(?:\*\s+|v\*\s+)", ""))
    add(F.regexp_replace(text[-1], rf"^[a-z]{{2,4}}(?:{'|'.join(MONTHS)})\d{{2}} ", ""))
    add(F.regexp_replace(text[-1], r"(?i)[-_\s][a-z][-_\s]series\s*$", ""))
    tail = F.regexp_extract(text[-1], TAIL, 2)
    add(F.when(tail.rlike(rf"(?i) {EXPOSURE}(?: |$)"), F.regexp_extract(text[-1], TAIL, 1)).otherwise(text[-1]))
    spelled = text[-1]
    for long, short in GENITIVES.items():
        spelled = F.regexp_replace(spelled, rf"(?i)(^| ){long}$", f"$1{short}")
    add(spelled)
    add(F.lower(text[-1]))
    add(F.regexp_replace(F.regexp_replace(text[-1], "-(?=[a-z])", ""), "[_ ]", ""))
    return text


def normalised_target(raw, synonyms: dict[str, str] | None = None) -> Column:
    """struct<key, cleaned, rules, pre_synonym_key>: the key that groups names, the text before letters are folded, the rules that changed something
    in their order, and the key before synonyms. All NULL with the rule 'blank' for a NULL or blank name. A synonym is one step; chains of them are
    followed by operators.aliases."""
    text = steps(raw)
    known = SYNONYMS if synonyms is None else synonyms
    pre = text[-1]
    to = F.lit(None).cast("string")
    if known:
        to = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[pre]
    fired = [F.when(before != after, F.lit(name)) for name, before, after in zip(RULES, text, text[1:])]
    rules = F.filter(F.array(*fired, F.when(to.isNotNull(), F.lit("synonym"))), lambda x: x.isNotNull())
    blank = F.coalesce(F.trim(F.regexp_replace(text[0], r"(?U)\s+", " ")), F.lit("")) == ""
    value = lambda c: F.when(~blank, c)
    return F.struct(value(F.coalesce(to, pre)).alias("key"), value(text[6]).alias("cleaned"), F.when(blank, F.array(F.lit("blank"))).otherwise(rules).alias("rules"), value(pre).alias("pre_synonym_key"))
