"""The lexicon join (LX1) and classification by it (CF1-CF6).

Occurrences of all phrases are found by one automaton in one pass over the texts (``phrases.marks``); a lexicon's rows then meet
the phrases that a text has by their folded form. The work per text is its words, whatever the lexicon's size; texts are not shuffled.
A pass can serve several lexicons (``marked``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import phrases

MAX_CATEGORIES = 4
OTHER = "OTHER"
#: Characters of phrases up to which a lexicon is one automaton; a larger one is cut, and each part is a pass over the texts.
MOST_CHARS = 8 << 20


def marked(texts: DataFrame, columns: tuple[str, ...], *lexicons: tuple[DataFrame, tuple[str, ...]]) -> DataFrame | None:
    """The texts with ``marks_<column>`` for each folded column: the occurrences of all phrases of some lexicons, given with
    their columns of phrases. None if they are too many for one automaton. Phrases go to the driver, after their size."""
    every = reduce(DataFrame.union, [phrases.listed(df, *names) for df, names in lexicons])
    if (every.agg(F.sum(F.length("phrase"))).first()[0] or 0) > MOST_CHARS:
        return None
    folded = [r[0] for r in every.select(text.fold(F.col("phrase"))).collect()]
    sent = texts.sparkSession.sparkContext.broadcast(phrases.Automaton(folded))
    return texts.withColumns({f"marks_{c}": phrases.marks(sent, F.col(c)) for c in columns})


def hits(texts: DataFrame, lexicon: DataFrame, id_column: str, text_column: str, phrase: str = "phrase", keep: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``lexicon`` that occur in each folded text, with the text's id and the columns of ``keep``. A row occurs once for a text.
    Occurrences that the texts carry already (``marks_<column>``) are used, and must be of all phrases asked for; otherwise they are
    found here, of the phrases and of the columns ``also``, in as many passes as the lexicon's size asks for."""
    name = f"marks_{text_column}"
    if name in texts.columns:
        return _met(texts, lexicon, id_column, name, phrase, keep)
    columns = tuple(dict.fromkeys([text_column, *[c.removeprefix("marks_") for c in keep if c.startswith("marks_")]]))
    whole = marked(texts, columns, (lexicon, (phrase, *also)))
    if whole is not None:
        return _met(whole, lexicon, id_column, name, phrase, keep)
    size = phrases.listed(lexicon, phrase, *also).agg(F.sum(F.length("phrase"))).first()[0]
    shards = -(-2 * size // MOST_CHARS)
    parts = [lexicon.filter(F.pmod(F.xxhash64(phrase), F.lit(shards)) == k) for k in range(shards)]
    return reduce(DataFrame.unionByName, [hits(texts, part, id_column, text_column, phrase, keep, also) for part in parts])


def _met(texts: DataFrame, lexicon: DataFrame, id_column: str, marks: str, phrase: str, keep: tuple[str, ...]) -> DataFrame:
    names = F.array_distinct(F.transform(marks, lambda m: m["phrase"]))
    there = texts.select(id_column, *[c for c in keep if c != id_column], F.explode(names).alias("_key"))
    # a lexicon that was made an automaton has at most MOST_CHARS characters of phrases
    return there.join(F.broadcast(lexicon.withColumn("_key", text.fold(F.col(phrase)))), "_key").drop("_key")


def keyword_categories(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(article_id, category, rule_ord, phrase): of each category the first keyword found (CF1).
    ``texts`` has article_id and text_f; ``keywords`` category, rule_ord, kw_ord, phrase."""
    found = hits(texts, keywords, "article_id", "text_f")
    return found.groupBy("article_id", "category").agg(F.min("rule_ord").alias("rule_ord"), F.min_by("phrase", "kw_ord").alias("phrase"))


def cooccurring_categories(texts: DataFrame, rules: DataFrame, have: DataFrame) -> DataFrame:
    """The same by a first verb and a first noun, where the category isn't there yet (CF2).
    ``rules`` has rule_ord, category, side (verb or noun), ord, phrase."""
    found = hits(texts, rules, "article_id", "text_f")
    pick = lambda side: F.min_by(F.when(F.col("side") == side, F.col("phrase")), F.when(F.col("side") == side, F.col("ord")))
    both = found.groupBy("article_id", "category", "rule_ord").agg(pick("verb").alias("verb"), pick("noun").alias("noun")).filter("verb is not null and noun is not null")
    first = both.groupBy("article_id", "category").agg(F.min("rule_ord").alias("rule_ord"), F.min_by(F.concat_ws("+", "verb", "noun"), "rule_ord").alias("phrase"))
    return first.join(have, ["article_id", "category"], "left_anti")


def found_categories(texts: DataFrame, keywords: DataFrame, rules: DataFrame) -> DataFrame:
    """What ``keyword_categories`` and then ``cooccurring_categories`` find, in one pass over the texts."""
    columns = ["category", "rule_ord", "side", "ord", "phrase"]
    both = keywords.withColumns({"side": F.lit("keyword"), "ord": F.col("kw_ord")}).select(*columns).unionByName(rules.select(*columns))
    least = lambda side: F.min(F.when(F.col("side") == side, F.struct("ord", "phrase")))
    ruled = hits(texts, both, "article_id", "text_f").groupBy("article_id", "category", "rule_ord").agg(least("keyword").alias("keyword"), least("verb").alias("verb"), least("noun").alias("noun"))
    pair = F.when(F.col("verb").isNotNull() & F.col("noun").isNotNull(), F.struct("rule_ord", F.concat_ws("+", "verb.phrase", "noun.phrase").alias("phrase")))
    out = ruled.groupBy("article_id", "category").agg(F.min(F.when(F.col("keyword").isNotNull(), F.col("rule_ord"))).alias("first"), F.min("keyword").alias("keyword"), F.min(pair).alias("pair"))
    return out.select("article_id", "category", F.coalesce("first", "pair.rule_ord").alias("rule_ord"), F.coalesce("keyword.phrase", "pair.phrase").alias("phrase")).filter("rule_ord is not null")


def ranked_categories(texts: DataFrame, found: DataFrame, most: int = MAX_CATEGORIES) -> DataFrame:
    """(article_id, categories): those with evidence in the headline first, then by rule; OTHER where there
    is none (CF3). ``texts`` has article_id and ``marks_head_f``, the occurrences in the headline."""
    heads = F.array_distinct(F.transform("marks_head_f", lambda m: m["phrase"]))
    both = found.join(texts.select("article_id", heads.alias("heads")), "article_id")
    parts = phrases.folded_all(F.split("phrase", r"\+"))
    in_head = F.forall(parts, lambda p: F.array_contains("heads", p))
    lists = both.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((~in_head).alias("body"), F.col("rule_ord"), F.col("category")))).alias("c"))
    chosen = lists.select("article_id", F.transform(F.slice("c", 1, most), lambda x: x["category"]).alias("found"))
    return texts.select("article_id").join(chosen, "article_id", "left").select("article_id", F.coalesce("found", F.array(F.lit(OTHER))).alias("categories"))


def flags(texts: DataFrame, markers: dict[str, list[str]], on_text: tuple[str, ...] = ("official_language",)) -> DataFrame:
    """The texts with a column for each flag: a marker in the headline, or for some flags anywhere (CF4)."""
    made = {name: text.contains_any(F.col("text_f" if name in on_text else "head_f"), words) for name, words in markers.items()}
    if "official_language" in made and "is_official" in texts.columns:
        made["official_language"] = F.col("is_official") | made["official_language"]
    return texts.withColumns(made)


Classifier = Callable[[DataFrame], DataFrame]
_classifiers: dict[str, Classifier] = {}


def register_classifier(name: str, classifier: Classifier) -> None:
    """A job from texts (article_id, text_f, head_f) to (article_id, categories) under a name (CF6)."""
    _classifiers[name] = classifier


def rule_classifier(keywords: DataFrame, rules: DataFrame | None = None, most: int = MAX_CATEGORIES) -> Classifier:
    """Categories by keywords and by rules of verbs and nouns. Texts that carry no occurrences yet get them here, in one pass."""

    def classify(texts: DataFrame) -> DataFrame:
        if "marks_head_f" not in texts.columns:
            own = [(keywords, ("phrase",)), *([(rules, ("phrase",))] if rules is not None else [])]
            texts = marked(texts, ("text_f", "head_f"), *own)
            if texts is None:
                raise ValueError("the rules of a classifier are one automaton: at most MOST_CHARS characters of phrases")
        found = keyword_categories(texts, keywords) if rules is None else found_categories(texts, keywords, rules)
        return ranked_categories(texts, found, most)

    return classify


def classify(texts: DataFrame, classifier: str | Classifier) -> DataFrame:
    return (_classifiers[classifier] if isinstance(classifier, str) else classifier)(texts)
