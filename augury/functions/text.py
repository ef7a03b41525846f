"""Text expressions: keys, tokens, n-grams, codes, money, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col

# Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Legal-form endings of company names.
LEGAL_FORMS = ("inc|incorporated|corp|corporation|co|company|llc|llp|lp|ltd|limited|plc|pllc|pc|gmbh|mbh|ag|kg|ug|ohg|gbr|ev|sa|sas|sarl|sl|srl|spa|spzoo|zoo|"
               "bv|nv|ab|oy|oyj|asa|aps|kft|zrt|sro|doo|dd|pty|pvt|bhd|sdn|kk|gk|corpn|intl|international")


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


def company_key(c: Column | str) -> Column:
    """Folded, & as and, punctuation to spaces, trailing legal forms dropped."""
    x = F.regexp_replace(fold(c), "&", " and ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N} ]", " "), " +", " "))
    return F.regexp_replace(F.regexp_replace(x, f"( and)?( ({LEGAL_FORMS}))+$", ""), f"( ({LEGAL_FORMS}))+$", "")


def norm_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", " "), " +", " "))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def words(c: Column | str) -> Column:
    """ASCII word tokens, lower case, in order."""
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """Light plural stemmer."""
    n = F.length(w)
    return (F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when((n > 4) & (w.endswith("sses") | w.endswith("shes") | w.endswith("ches") | w.endswith("xes")), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substring(w, F.lit(1), n - 1)).otherwise(w))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces."""
    size = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigrams(c: Column | str) -> Column:
    """Distinct character trigrams of the text padded by two spaces in front and one behind."""
    padded = F.concat(F.lit("  "), F.lower(col(c)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


_MONEY = r"(?i)([$€£]|EUR)\s?([0-9]+(?:\.[0-9]+)?)\s?([kmb]?)"


def money(c: Column | str) -> Column:
    """$3.1M -> 3100000.0, EUR 149k -> 149000.0; null where there is no amount."""
    number, scale = F.regexp_extract(col(c), _MONEY, 2), F.lower(F.regexp_extract(col(c), _MONEY, 3))
    factor = F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).otherwise(1.0)
    return F.when(number != "", number.cast("double") * factor)


def currency(c: Column | str) -> Column:
    """USD, EUR or GBP of the amount that money() reads; null without one."""
    sign = F.lower(F.regexp_extract(col(c), _MONEY, 1))
    return F.when(sign == "$", "USD").when(sign == "£", "GBP").when(sign != "", "EUR")


def number_tokens(c: Column | str) -> Column:
    """Numbers in a text, distinct, without thousands commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(r"([0-9][0-9,.]*[0-9]|[0-9])"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "")))


def strip_tags(c: Column | str) -> Column:
    """Markup to text: scripts, styles and comments go, tags become spaces, the common entities are decoded."""
    x = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fingerprint(*parts: Column | str) -> Column:
    """md5 of the normalised parts."""
    return F.md5(F.concat_ws("|", *(norm_title(F.coalesce(col(p), F.lit(""))) for p in parts)))


#: Tags that say nothing, and acronyms with their capitals.
GENERIC_TAGS = ("innovation", "technology", "trend", "trends", "research", "startup", "startups", "market", "business", "science", "news")
ACRONYMS = ("ai", "ar", "vr", "eu", "us", "uk", "rna", "dna", "fda", "ema", "nasa", "ipo", "led", "uav", "gdpr", "ip", "pfas", "hiv", "iso", "erp")


def thematic_tags(tags: Column) -> Column:
    """Tags in one spelling, distinct, in order, without the generic ones."""
    said = F.transform(tags, lambda x: F.trim(F.translate(F.lower(x), "_-", "  ")))
    return F.array_distinct(F.filter(said, lambda x: (x != "") & ~x.isin(*GENERIC_TAGS)))


def tag_label(tag: Column) -> Column:
    """Capitals at the start of words, acronyms in capitals."""
    return F.array_join(F.transform(F.split(tag, " +"), lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def iso_label(day: Column | str) -> Column:
    """2024-W05, of the week's own year."""
    thursday = F.date_add(F.date_trunc("week", col(day)).cast("date"), 3)
    return F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(thursday))


def week_monday(label: Column | str) -> Column:
    """The Monday of 2024-W05; null where the label or its week does not exist."""
    y, w = (F.regexp_extract(col(label), r"^([0-9]{4})-W([0-9]{1,2})$", i).try_cast("int") for i in (1, 2))
    monday = F.date_add(F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date"), (w - 1) * 7)
    return F.when(w.between(1, 53) & (F.year(F.date_add(monday, 3)) == y), monday)
