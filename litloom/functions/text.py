"""Scalar text, identifier and date functions as Column expressions: no Python workers, all inside code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities, words, patterns and labels that results depend on. Of the stopwords those that a token can be:
# three letters or more and no apostrophe.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
STOPWORDS = """about above after again against all and any are because been before being below between both but cannot could
did does doing down during each few for from further had has have having her here hers herself him himself his how into its
itself more most myself nor not off once only other ought our ours ourselves out over own same she should some such than that
the their theirs them themselves then there these they this those through too under until very was were what when where which
while who whom why with would you your yours yourself yourselves""".split()
HEDGES = ["may", "could", "might", "potentially", "hypothesize", "preliminary", "suggests"]
ACRONYMS = """CNN RNN LSTM GRU BERT GPT SVM KNN GAN VAE RL DRL NLP ML AI DL LLM GNN SGD AUC ROC MSE RMSE MAE F1 FPR TPR IDS NIDS API
CPU GPU TPU RAM NSL-KDD CICIDS2017 UNSW-NB15 KDD99 MNIST MIMIC-III""".split()
BULLETS = r"^(\s*[-*•–—]\s*|\s*\d+[.)]\s*|\s*\([a-zA-Z0-9]+\)\s*)+"
STATUS = {
    "AVAILABLE": "DISCOVERABLE", "FULLTEXT_AVAILABLE": "DISCOVERABLE", "DISCOVERABLE": "DISCOVERABLE", "QUEUED": "QUEUED", "FETCH_QUEUED": "QUEUED",
    "DOWNLOADING": "DOWNLOADING", "FETCHING": "DOWNLOADING", "DOWNLOADED": "DOWNLOADED", "FULLTEXT_DOWNLOADED": "DOWNLOADED",
    "UNAVAILABLE": "UNAVAILABLE", "FULLTEXT_UNAVAILABLE": "UNAVAILABLE", "NOT_CHECKED": "NOT_CHECKED", "FULLTEXT_NOT_CHECKED": "NOT_CHECKED",
    "FAILED": "FAILED", "FETCH_FAILED": "FAILED", "FULLTEXT_FAILED": "FAILED",
}
SURVEY = r"(?i)\bsurvey\b"
REVIEW = r"(?i)\b(a review of|systematic (literature )?review|overview and perspective|state[- ]of[- ]the[- ]art review|literature review)\b"
#: Source -> label -> the source's own types; for the last source words that its type holds, in order.
KINDS = {
    "openalex": {
        "RESEARCH_ARTICLE": ["article", "journal-article", "preprint", "posted-content"], "CONFERENCE_PAPER": ["conference-paper", "conference-abstract", "proceedings"],
        "BOOK_CHAPTER": ["book-chapter", "book-section", "book", "monograph", "edited-book"], "REVIEW": ["review", "systematic-review"], "EDITORIAL": ["editorial", "letter", "note"],
        "FRONT_MATTER": ["reference-entry", "erratum", "paratext"], "OTHER": ["peer-review", "software", "dataset", "other"],
    },
    "crossref": {
        "RESEARCH_ARTICLE": ["journal-article", "posted-content"], "CONFERENCE_PAPER": ["proceedings-article", "proceedings"],
        "BOOK_CHAPTER": ["book-chapter", "book-section", "monograph", "edited-book", "book", "reference-book"], "EDITORIAL": ["editorial", "letter"],
        "FRONT_MATTER": ["journal", "journal-issue", "component"], "OTHER": ["peer-review", "dataset"],
    },
    "semantic_scholar": {"RESEARCH_ARTICLE": ["journal", "article"], "CONFERENCE_PAPER": ["conference", "proceedings"], "REVIEW": ["review"], "BOOK_CHAPTER": ["book"], "EDITORIAL": ["editorial"]},
}
BUCKETS = {
    "ABSTRACT": "abstract|summary", "INTRO_BACKGROUND": r"intro|background|overview|motivation|related\s*work",
    "METHODS": "method|methodology|approach|architecture|system|model|implementation|framework",
    "RESULTS": "result|experiment|evaluation|finding|empirical|performance|analysis", "CONCLUSION_LIMITATIONS": "conclusion|limit|future|threat|discussion",
}
NUMBERS = r"(?i)(\b\d+(\.\d+)?%|\bp\s*[<>=]\s*\d|\bF1\b|\bAUC\b|\baccuracy\b|\b\d+\.\d+\b)"
FORMULAS = r"(?i)(=|\+|-|\*|/|\^|\\sum|\\alpha|\\beta|\\theta|\\sigma|\\in|\bargmax\b)"
EDGE_LABELS = ["SHORT_CHUNK_UNDER_150_CHARS", "LONG_DENSE_CHUNK_OVER_1800_CHARS", "DENSE_NUMERICAL_AND_FORMULAS", "QUANTITATIVE_METRICS_AND_PERCENTAGES"]
VENUE_DOMAINS = {"Healthcare / Oncology": ["health", "medic", "oncol"], "Cybersecurity / Privacy": ["sec", "crypt"], "Finance / Economics": ["fin"]}
NAME_DOMAINS = {
    "Security & Privacy": ["privacy", "federated", "security", "attack", "injection", "vulnerability"],
    "Healthcare & Oncology": ["cancer", "tumor", "clinical", "patient", "medical", "oncology", "pathology"],
    "Computer Vision": ["vision", "image", "convolutional", "cnn", "radiology"], "Natural Language Processing": ["language", "nlp", "sentiment", "text", "translation"],
}
DEFAULT_DOMAIN = "Machine Learning / Optimization"
MIN_TOKEN, SHORT_CHUNK, LONG_CHUNK, TOKENS_A_WORD = 3, 150, 1800, 1.3


def _accents() -> tuple[str, str]:
    """Letters with a canonical decomposition into one Latin letter and marks, and those letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(x: Column) -> Column:
    return F.translate(x, *_accents())


def squeeze(x: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"[\s]+", " "))


def unescape(x: Column) -> Column:
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def clean_text(x: Column) -> Column:
    """entities, tags, blanks before punctuation, white space; null if nothing is left."""
    x = F.regexp_replace(unescape(x), r"<[^>]+>", " ")
    return F.nullif(squeeze(F.regexp_replace(x, r"\s+([.,;:!?])", "$1")), F.lit(""))


def title_key(x: Column) -> Column:
    """a title for matching: no accents, lower case, hyphens as blanks, letters and digits only."""
    x = F.replace(F.lower(strip_accents(unescape(F.coalesce(x, F.lit(""))))), F.lit("-"), F.lit(" "))
    return squeeze(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", ""))


def inverted_to_text(index: Column) -> Column:
    """map word -> positions to the text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda e: e["w"]), " ")


def author_name(x: Column) -> Column:
    """struct<first, last> of "Last, First" or "First ... Last"; one token is a last name."""
    x = squeeze(x)
    comma, parts = F.split(x, r"\s*,\s*", 2), F.split(x, " ")
    first = F.nullif(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "), F.lit(""))
    return F.struct(
        F.when(x.contains(","), F.nullif(F.element_at(comma, 2), F.lit(""))).otherwise(first).alias("first"),
        F.when(x.contains(","), F.element_at(comma, 1)).otherwise(F.element_at(parts, -1)).alias("last"),
    )


def doi(x: Column) -> Column:
    """bare lower-case DOI, or null."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(bare, r"\.+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$") | (bare.startswith("10.") & bare.contains("/")), bare)


def arxiv_id(x: Column) -> Column:
    """modern or legacy arXiv id without its version, or null."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^(https?://arxiv\.org/(abs|pdf)/|arxiv:\s*)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(bare.rlike(r"^\d{4}\.\d{4,5}$") | bare.rlike(r"^[a-z-]+(\.[a-z]{2})?/\d{7}$"), bare)


def orcid(x: Column) -> Column:
    """0000-0000-0000-000X, upper case, or null."""
    return F.nullif(F.regexp_extract(F.upper(x), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """F8: YYYY, YYYY-MM or YYYY-MM-DD, as far as parts are there."""
    y, m, d = (F.lpad(c.cast("string"), n, "0") for c, n in ((year, 4), (month, 2), (day, 2)))
    return F.when(year.isNull(), F.lit(None)).when(month.isNull(), y).when(day.isNull(), F.concat_ws("-", y, m)).otherwise(F.concat_ws("-", y, m, d))


def publication_dates(source: Column, **raw: Column) -> Column:
    """struct<published, online, print, issued, year> by the ladder of the record's source. raw: the record's fields as
    strings (year fields as integers), those that there are: published_online, published_print, issued, created (crossref, as
    F8 gives them); publication_date, publication_year, created_date (openalex); published (arxiv); publicationDate, year
    (semantic_scholar). Another source has no dates."""
    get = lambda name: raw.get(name, F.lit(None))
    text = lambda x: x.cast("string")
    whole = lambda x: x.cast("int")
    online, printed, issued = get("published_online"), get("published_print"), F.coalesce(get("issued"), get("created"))
    first, day = F.coalesce(online, printed, issued), F.substring_index(get("published"), "T", 1)
    ladders = {
        "crossref": (first, online, printed, issued, F.nullif(F.regexp_extract(first, r"^(\d{4})", 1), F.lit(""))),
        "openalex": (get("publication_date"), get("publication_date"), F.lit(None), get("created_date"), get("publication_year")),
        "arxiv": (day, day, F.lit(None), F.lit(None), F.nullif(F.regexp_extract(day, r"^(\d{4})", 1), F.lit(""))),
        "semantic_scholar": (get("publicationDate"), get("publicationDate"), F.lit(None), F.lit(None), get("year")),
    }

    def by_source(k, cast):
        out = F.lit(None)
        for name, own in ladders.items():
            out = F.when(source == name, cast(own[k])).otherwise(out)
        return cast(out)

    return F.struct(*[by_source(k, text).alias(n) for k, n in enumerate(("published", "online", "print", "issued"))], by_source(4, whole).alias("year"))


def document_type(kind: Column, source: Column, title: Column) -> Column:
    """cues of the title first (survey, then review), then the source's own types; UNKNOWN if it says nothing."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    exact = {name: F.lit("UNKNOWN") for name in ("openalex", "crossref")}
    for name in exact:
        for label, own in KINDS[name].items():
            exact[name] = F.when(k.isin(own), label).otherwise(exact[name])
    holds = F.lit("RESEARCH_ARTICLE")
    for label, own in reversed(KINDS["semantic_scholar"].items()):
        holds = F.when(k.rlike("|".join(own)), label).otherwise(holds)
    by_source = F.when(source == "arxiv", "RESEARCH_ARTICLE").when(source == "semantic_scholar", holds)
    by_source = by_source.when(source == "openalex", exact["openalex"]).when(source == "crossref", exact["crossref"]).otherwise("UNKNOWN")
    t = F.coalesce(title, F.lit(""))
    return F.when(t.rlike(SURVEY), "SURVEY").when(t.rlike(REVIEW), "REVIEW").otherwise(by_source)


def fulltext_status(x: Column) -> Column:
    """legacy status, in any case, to the current one; unknown ones pass as they are."""
    known = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    return F.coalesce(F.element_at(known, F.upper(F.trim(x))), x)


def normal_text(x: Column) -> Column:
    """white space, one pass of outer punctuation, lower case."""
    return F.lower(F.trim(F.regexp_replace(squeeze(x), r"^[^\p{L}\p{N}_]|[^\p{L}\p{N}_]$", "")))


def entity_name(x: Column) -> Column:
    """bullets and outer punctuation off, known acronyms in upper case, other case kept."""
    bare = squeeze(F.regexp_replace(F.trim(x), BULLETS, ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[\s.,;:!?\"'`(\[{]+", ""), r"[\s.,;:!?\"'`)\]}]+$", "")
    return F.when(F.upper(bare).isin(ACRONYMS), F.upper(bare)).otherwise(bare)


def statement_text(x: Column) -> Column:
    """bullets off, white space collapsed, ends with . ! or ?"""
    return closed(squeeze(F.regexp_replace(x, BULLETS, "")))


def closed(x: Column) -> Column:
    """x, with a full stop where it does not end with . ! or ?"""
    return F.when(x.endswith(".") | x.endswith("!") | x.endswith("?"), x).otherwise(F.concat(x, F.lit(".")))


def evidence_span(text: Column, surface: Column) -> Column:
    """struct<start, end> (code points, half open): exact, else ignoring case, else white space; null if absent."""
    at = F.coalesce(F.nullif(F.position(surface, text), F.lit(0)), F.nullif(F.position(F.lower(surface), F.lower(text)), F.lit(0)), F.nullif(F.position(squeeze(surface), text), F.lit(0)))
    return F.when(at.isNotNull() & (F.length(surface) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(surface)).alias("end")))


def words_of(x: Column) -> Column:
    """Lower-case runs of letters, digits, _ and -; an empty one where there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s-]+", " ")), r"\s+")


def is_token(w: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return (F.length(w) >= MIN_TOKEN) & ~w.isin(stopwords)


def tokens(x: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """F16: lower-case tokens of three characters or more that are not stopwords."""
    return F.filter(words_of(x), lambda w: is_token(w, stopwords))


def token_set(x: Column) -> Column:
    """distinct tokens, stopwords too."""
    return F.array_distinct(tokens(x, [""]))


def paragraph(x: Column) -> Column:
    """words broken by a hyphen at a line's end are joined; white space collapses."""
    return squeeze(F.regexp_replace(x, r"(\p{L})-\n\s*(\p{Ll})", "$1$2"))


def furniture_key(x: Column) -> Column:
    """key of running heads: numbers to #, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\b\d+\b", "#")))


def section_bucket(title: Column) -> Column:
    """the first bucket whose words the title holds, in any case; OTHER without a title or words."""
    out = F.lit("OTHER")
    for name, words in reversed(BUCKETS.items()):
        out = F.when(title.rlike(f"(?i){words}"), name).otherwise(out)
    return out


def edge_case(x: Column) -> Column:
    """why a chunk is a notable one, the first of too short, too long, numbers with formulas, numbers; or null."""
    bare = F.regexp_replace(x, r"^\s+|\s+$", "")
    numbers, (short, long, both, some) = bare.rlike(NUMBERS), EDGE_LABELS
    return F.when(F.length(bare) < SHORT_CHUNK, short).when(F.length(bare) > LONG_CHUNK, long).when(numbers & bare.rlike(FORMULAS), both).when(numbers, some)


def entity_template(name: Column, category: Column, description: Column, aliases: Column) -> Column:
    """the text of an entity that is embedded."""
    listed = F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), ", ")
    return F.trim(F.concat(name, F.lit(" ("), F.coalesce(category, F.lit("None")), F.lit("). "), F.coalesce(description, F.lit("")), F.lit(" Aliases: "), listed))


def node_domain(domain: Column, venues: Column, name: Column) -> Column:
    """the given domain, else that of the first venue with a known word, else that of the name's words, else the default."""

    def ladder(x, labels, default):
        out = default
        for label, words in reversed(labels.items()):
            out = F.when(F.lower(x).rlike("|".join(words)), label).otherwise(out)
        return out

    of_venue = F.transform(venues, lambda v: ladder(v, VENUE_DOMAINS, F.lit(None)))
    return F.coalesce(F.nullif(domain, F.lit("")), F.get(F.filter(of_venue, lambda v: v.isNotNull()), F.lit(0)), ladder(name, NAME_DOMAINS, F.lit(DEFAULT_DOMAIN)))


def word_total(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).cast("long")


def token_estimate(x: Column) -> Column:
    """int(words * 1.3), in tenths so that no rounding enters."""
    return F.floor(word_total(x) * 13 / 10).cast("long")


def coverage(query: Column, doc: Column) -> Column:
    """part of the query's tokens that the document has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, doc)) / F.size(query)).otherwise(F.lit(0.0))


def corruption(x: Column) -> Column:
    """replacement and control characters."""
    return (F.length(x) - F.length(F.regexp_replace(x, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", ""))).cast("long")


def hedged(x: Column) -> Column:
    """a hedge word between blanks."""
    return F.concat(F.lit(" "), F.lower(x), F.lit(" ")).rlike(" (" + "|".join(HEDGES) + ") ")


def short_id(prefix: str, *parts: Column, size: int = 12) -> Column:
    """Identifier of :-joined parts by SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, size))


def uuid5_id(prefix: str, x: Column, size: int = 12) -> Column:
    """First hex digits of the version 5 UUID in the URL name space."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(x, "UTF-8"))), 1, size))
