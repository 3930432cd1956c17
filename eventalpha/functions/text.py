"""Text cleaning, splitting and truncation as column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+|www\.\S+"
EMAIL = r"\S+@\S+\.\S+"
# Patterns and item numbers that results depend on.
BOILERPLATE = (
    r"UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION.*?Washington, D\.C\. 20549",
    r"FORM \d+-[A-Z]+",
    r"Commission File Number:.*?\n",
    r"Indicate by check mark.*?\n",
    r"Table of Contents",
    r"Page \d+ of \d+",
)
ITEM_HEADER = r"(?i)item\s+(\d+\.\d+)\s+([^\n]+)\n"
RELEVANT_ITEMS = {"8-K": ("1.01", "2.02", "2.05", "8.01"), "10-K": ("1.01", "7.01"), "10-Q": ("1.01", "2.02")}


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, tables and tags."""
    body = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<table\b.*?</table>", " ")
    return squeeze(F.regexp_replace(body, r"<[^>]+>", " "))


def clean_text(text: Column, urls: bool = True, emails: bool = True, numbers: bool = False, lowercase: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    for wanted, pattern in ((urls, URL), (emails, EMAIL), (numbers, r"\d+")):
        if wanted:
            text = F.regexp_replace(text, pattern, " ")
    return squeeze(F.lower(text) if lowercase else text)


def clean_for_sentiment(text: Column) -> Column:
    """URLs, addresses and signs go; letters, digits, punctuation and case stay. An address is any run
    with an @ and a full stop behind it, a URL runs to the next white space, both with the punctuation
    that ends them."""
    return squeeze(F.regexp_replace(clean_text(text), r"""[^\p{L}\p{N}_\s.,!?;:\-'"()]""", " "))


def strip_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, "(?is)" + pattern, " ")
    return text


def sentences(text: Column, least: int = 10) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def _last(text: Column, mark: str) -> Column:
    """1-based place of the last ``mark``, 0 if there is none."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 2).otherwise(F.lit(0))


def truncate_sentence(text: Column, most: int = 5000) -> Column:
    """Cut at ``most`` characters, or after a full stop in the last fifth of them."""
    head = F.left(text, F.lit(most))
    at = _last(head, ".")
    return F.when(F.length(text) <= most, text).when(at - 1 > most * 0.8, F.left(head, at)).otherwise(head)


def truncate_word(text: Column, most: int = 500) -> Column:
    """Cut at a space in the last 30 %, else after a sentence mark in the second half, else hard."""
    head = F.left(text, F.lit(most))
    space = _last(head, " ")
    out = F.when(F.length(text) <= most, text).when(space - 1 > most * 0.7, F.trim(F.left(head, space - 1)))
    for mark in (". ", "! ", "? ", "\n"):
        at = _last(head, mark)
        out = out.when(at - 1 > most * 0.5, F.trim(F.left(head, at)))
    return out.otherwise(F.trim(head))


def word_tokens(text: Column, least: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    """Runs of a-z of the lower-cased text."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    stop = F.array(*[F.lit(s) for s in stopwords]).cast("array<string>")
    return F.filter(found, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def context_words(tokens: Column, terms: tuple[str, ...], window: int) -> Column:
    """The tokens up to ``window`` places around each term, terms left out, repeats kept."""
    wanted = F.array(*[F.lit(t) for t in terms])
    around = F.transform(
        F.filter(F.transform(tokens, lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull()),
        lambda i: F.slice(tokens, F.greatest(i - window + 1, F.lit(1)), i + window + 1 - F.greatest(i - window, F.lit(0))),
    )
    return F.filter(F.flatten(around), lambda w: ~F.array_contains(wanted, w))


def filing_date(text: Column) -> Column:
    """From the first 5000 characters of a filing."""
    head = F.left(text, F.lit(5000))
    tries = [
        F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
        for p in (r"FILED AS OF DATE:\s*(\d{8})", r"<FILING-DATE>(\d{8})", r"CONFORMED PERIOD OF REPORT:\s*(\d{8})")
    ]
    return F.try_to_date(F.coalesce(*tries), "yyyyMMdd")


def item_sections(text: Column, header: str = ITEM_HEADER) -> Column:
    """array<struct<item,title,content>> in order of occurrence."""
    items, titles = (F.regexp_extract_all(text, F.lit(header), F.lit(k)) for k in (1, 2))
    bodies = F.slice(F.split(text, header, -1), F.lit(2), F.size(items))
    return F.transform(
        F.arrays_zip(items.alias("item"), titles.alias("title"), bodies.alias("content")),
        lambda s: F.struct(s["item"].alias("item"), F.trim(s["title"]).alias("title"), F.regexp_replace(s["content"], r"^\s+|\s+$", "").alias("content")),
    )


def relevant_text(sections: Column, filing_type: Column, text: Column, relevant: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Contents of the items that matter for the filing type, last of each item, in order of the
    items' first occurrence; the whole text where there are none."""
    wanted = F.create_map(*[x for k, v in (relevant or RELEVANT_ITEMS).items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    mine = F.try_element_at(wanted, filing_type)
    kept = F.filter(sections, lambda s: F.array_contains(mine, s["item"]))
    order = F.array_distinct(F.transform(kept, lambda s: s["item"]))
    last = F.transform(order, lambda i: F.element_at(F.filter(kept, lambda s: s["item"] == i), -1)["content"])
    return F.when(mine.isNull() | (F.size(kept) == 0), text).otherwise(F.array_join(last, " "))


def post_text(title: Column, body: Column) -> Column:
    """Title and body; removed bodies are blank. Null if nothing is left."""
    body = F.when(F.trim(body).isin("[removed]", "[deleted]"), F.lit("")).otherwise(F.coalesce(body, F.lit("")))
    return F.nullif(F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), body)), F.lit(""))
