"""Part-of-speech tags, lemmas, noun chunks and entities from word lists and patterns.

The in-place functions work on a text's token array and need no shuffle. The table forms join a
learned or given lexicon to a token table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordtrail.functions import regex
from wordtrail.functions.arrays import let
from wordtrail.functions.hashing import _col
from wordtrail.operators.lookup import lookup_join, salted_join

# The Penn tags of nouns and of verbs.
NOUN_TAGS = ["NN", "NNS", "NNPS", "NNP"]
VERB_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]

# Closed-class words and their Penn tags.
WORD_TAGS = {
    "DT": ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no"],
    "IN": ["about", "after", "at", "because", "before", "by", "for", "from", "if", "in", "into", "of",
           "on", "over", "since", "than", "toward", "under", "while", "with", "without"],
    "TO": ["to"],
    "CC": ["and", "but", "nor", "or", "yet"],
    "PRP": ["he", "her", "him", "i", "it", "me", "she", "them", "they", "us", "we", "you"],
    "PRP$": ["his", "its", "my", "our", "their", "your"],
    "MD": ["'d", "'ll", "can", "could", "may", "might", "must", "shall", "should", "will", "would"],
    "WP": ["what", "who", "whom"],
    "WDT": ["which"],
    "WRB": ["how", "when", "where", "why"],
    "EX": ["there"],
    "POS": ["'s"],
    "JJ": ["good", "great", "high", "higher", "large", "long", "new", "next", "old", "other", "own",
           "red", "same", "small"],
    "RB": ["n't", "also", "here", "never", "not", "now", "often", "so", "today", "tomorrow", "too", "very"],
    "VB": ["be"],
    "VBP": ["'m", "'re", "'ve", "am", "are", "do", "have"],
    "VBZ": ["does", "has", "is"],
    "VBD": ["did", "had", "ran", "saw", "was", "were"],
    "VBN": ["been", "done", "given", "seen", "taken"],
    "CD": ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eighteen"],
    "NNS": ["children", "feet", "men", "mice", "people", "teeth", "women"],
}
# Word endings and the tag they suggest; no ending is part of another tag's ending.
ENDING_TAGS = {
    "VBG": ["ing"],
    "VBD": ["ed"],
    "RB": ["ly"],
    "JJ": ["ous", "ful", "able", "ible", "ive", "ish", "al"],
    "NN": ["tion", "ment", "ness", "ity", "ance", "ence", "er", "or"],
    "NNS": ["tions", "ments", "ers", "ors"],
}
# Forms that are no words.
SYMBOL = r"^[^\p{L}\p{N}]+$"
NUMBER = r"^[0-9][0-9.,]*$"
PROPER = r"^\p{Lu}\p{L}+$"
# Tag names in words.
TAG_NAMES = {
    "CC": "conjunction, coordinating", "CD": "cardinal number", "DT": "determiner",
    "EX": "existential there", "IN": "conjunction, subordinating or preposition",
    "JJ": "adjective", "MD": "verb, modal auxiliary", "NN": "noun, singular or mass",
    "NNP": "noun, proper singular", "NNPS": "noun, proper plural", "NNS": "noun, plural",
    "PRP": "pronoun, personal", "PRP$": "pronoun, possessive", "RB": "adverb",
    "POS": "possessive ending", "SYM": "symbol or punctuation", "TO": "infinitival to", "VB": "verb, base form", "VBD": "verb, past tense",
    "VBG": "verb, gerund or present participle", "VBN": "verb, past participle",
    "VBP": "verb, non-3rd person singular present", "VBZ": "verb, 3rd person singular present",
    "WDT": "wh-determiner", "WP": "wh-pronoun, personal", "WRB": "wh-adverb",
    "PROPN": "proper noun", "NOUN": "noun", "VERB": "verb", "ADJ": "adjective",
    "GPE": "countries, cities, states", "MONEY": "monetary values, including unit",
    "DATE": "absolute or relative dates or periods", "nsubj": "nominal subject",
}
# Irregular forms, as (form, tag class, lemma).
LEMMAS = [
    ("am", "VERB", "be"), ("are", "VERB", "be"), ("is", "VERB", "be"), ("was", "VERB", "be"),
    ("were", "VERB", "be"), ("been", "VERB", "be"), ("being", "VERB", "be"),
    ("has", "VERB", "have"), ("had", "VERB", "have"), ("having", "VERB", "have"),
    ("does", "VERB", "do"), ("did", "VERB", "do"), ("done", "VERB", "do"), ("doing", "VERB", "do"),
    ("ran", "VERB", "run"), ("running", "VERB", "run"), ("runs", "VERB", "run"),
    ("saw", "VERB", "see"), ("seen", "VERB", "see"), ("seeing", "VERB", "see"),
    ("went", "VERB", "go"), ("gone", "VERB", "go"), ("going", "VERB", "go"),
    ("gave", "VERB", "give"), ("given", "VERB", "give"), ("took", "VERB", "take"),
    ("taken", "VERB", "take"), ("made", "VERB", "make"), ("making", "VERB", "make"),
    ("meeting", "VERB", "meet"), ("met", "VERB", "meet"), ("written", "VERB", "write"),
    ("wrote", "VERB", "write"), ("said", "VERB", "say"), ("sat", "VERB", "sit"),
    ("mice", "NOUN", "mouse"), ("men", "NOUN", "man"), ("women", "NOUN", "woman"),
    ("children", "NOUN", "child"), ("feet", "NOUN", "foot"), ("teeth", "NOUN", "tooth"),
]


def guess_tag(word: Column, lower: Column | None = None) -> Column:
    """Tag of an unknown word from its form alone.

    The patterns are tried only on words that do not begin with a plain letter, or that hold a
    capital; all others are settled by comparing their last letters.
    """
    lower = F.lower(word) if lower is None else lower
    first = F.substring(lower, 1, 1)
    tag = (F.when(~first.between("a", "z") & lower.rlike(SYMBOL), "SYM")
            .when(first.between("0", "9") & lower.rlike(NUMBER), "CD"))
    for name, endings in ENDING_TAGS.items():
        for size in sorted({len(e) for e in endings}):
            tag = tag.when(F.right(lower, F.lit(size)).isin([e for e in endings if len(e) == size]), name)
    return tag.when((word != lower) & word.rlike(PROPER), "NNP").otherwise("NN")


def known_tag(lower: Column) -> Column:
    """Tag of a closed-class word (given in lower case), null for all others."""
    tag = None
    for name, words in WORD_TAGS.items():
        hit = lower.isin(words)
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return F.when(lower.isin([w for words in WORD_TAGS.values() for w in words]), tag)


def in_context(guess: Column, before: Column) -> Column:
    """A guessed tag corrected by the preceding word (lower case, null at the start).

    After a determiner or possessive an open-class word in -ing, -ed or unknown form is a noun;
    after *to* or a modal it is a base verb; a capital opening a text is no proper noun.
    """
    return (F.when(guess.isin("VBG", "VBD", "NN") & before.isin(AFTER_NOMINAL), "NN")
             .when(guess.isin("NN", "NNP") & before.isin(AFTER_VERBAL), "VB")
             .when((guess == "NNP") & before.isNull(), "NN").otherwise(guess))


def tag_word(word: Column, lower: Column, before: Column) -> Column:
    """Tag of one token: word list first, then the guess in its context."""
    return F.coalesce(known_tag(lower), let(guess_tag(word, lower), lambda g: in_context(g, before)))


# Words after which a noun, or a base verb, is expected.
AFTER_NOMINAL = WORD_TAGS["DT"] + WORD_TAGS["PRP$"]
AFTER_VERBAL = WORD_TAGS["TO"] + WORD_TAGS["MD"]


def tag_tokens(tokens: Column | str) -> Column:
    """Array of Penn tags for one text's token array, in place."""
    def tags(words: Column) -> Column:
        lowered = F.transform(words, F.lower)
        return let(lowered, lambda lowers: F.transform(
            F.arrays_zip(words.alias("word"), lowers.alias("lower")),
            lambda w, i: tag_word(w.word, w.lower, F.when(i > 0, F.get(lowers, i - 1)))))
    return let(_col(tokens), tags)


def tag_class(tag: Column | str) -> Column:
    """Coarse class of a Penn tag: NOUN, VERB or the tag itself."""
    tag = _col(tag)
    return F.when(tag.isin(NOUN_TAGS), "NOUN").when(tag.isin(VERB_TAGS), "VERB").otherwise(tag)


def count_tags(tags: Column | str, names: list[str], inside: bool = True) -> Column:
    """How many tags are in (or outside) the given set."""
    return F.size(F.filter(_col(tags), lambda t: t.isin(names) if inside else ~t.isin(names)))


def nouns(tags: Column | str) -> Column:
    return count_tags(tags, NOUN_TAGS)


def verbs(tags: Column | str) -> Column:
    return count_tags(tags, VERB_TAGS)


def others(tags: Column | str) -> Column:
    return count_tags(tags, NOUN_TAGS + VERB_TAGS, inside=False)


def tagged_rows(df: DataFrame, key: str, tokens: Column, *carried: str) -> DataFrame:
    """Token table ``(key, *carried, pos, token, tag)``; no shuffle.

    The token and the one before it are exploded together, so that the tag rules run as compiled
    row expressions. A text without tokens keeps one row with null token and tag.
    """
    words = df.select(key, *carried, tokens.alias("_words"))
    before = F.concat(F.array(F.lit(None).cast("string")),
                      F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))))
    pairs = F.when(F.size("_words") > 0, F.arrays_zip(F.col("_words").alias("token"), before.alias("before")))
    rows = words.select(key, *carried, F.posexplode_outer(pairs).alias("pos", "t")).select(
        key, *carried, "pos", "t.token", F.lower("t.token").alias("_lower"), F.lower("t.before").alias("_before"))
    guessed = rows.withColumn("_guess", guess_tag(F.col("token"), F.col("_lower")))
    tag = F.coalesce(known_tag(F.col("_lower")), in_context(F.col("_guess"), F.col("_before")))
    return guessed.select(key, *carried, "pos", "token", F.when(F.col("token").isNotNull(), tag).alias("tag"))


def learn_tags(tagged: DataFrame) -> DataFrame:
    """Most frequent tag per lower-case word; ties go to the alphabetically first tag."""
    seen = tagged.filter(F.col("token").isNotNull())
    counts = seen.groupBy(F.lower("token").alias("word"), "tag").agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(
        F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))


def apply_tags(tokens: DataFrame, lexicon: DataFrame, spread: list[str]) -> DataFrame:
    """Tag a token table from a learned lexicon; unknown words by their ending."""
    keyed = tokens.withColumn("word", F.lower("token"))
    tagged = lookup_join(keyed, lexicon, "word", spread)
    return tagged.withColumn("tag", F.coalesce("tag", guess_tag(F.col("token")))).drop("word")


def learn_endings(tagged: DataFrame, longest: int = 4, weight: str | None = None) -> DataFrame:
    """``(ending, tag)``: the most frequent tag of the tokens whose lower-case word ends so and is
    longer, for endings of 1 to ``longest`` letters; ties go to the alphabetically first tag. A
    row counts once, or as often as ``weight`` says."""
    seen = tagged.filter(F.col("token").isNotNull())
    times = F.count("*") if weight is None else F.sum(weight)
    counts = seen.groupBy(F.lower("token").alias("word"), "tag").agg(times.alias("n"))
    each = counts.select(F.explode(_endings(F.col("word"), longest)).alias("ending"), "tag", "n")
    return each.groupBy("ending", "tag").agg(F.sum("n").alias("n")).groupBy("ending").agg(
        F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))


def _endings(word: Column, longest: int) -> Column:
    sizes = F.filter(F.array(*[F.lit(n) for n in range(1, longest + 1)]), lambda n: n < F.length(word))
    return F.transform(sizes, lambda n: F.right(word, n))


def tag_words(words: DataFrame, lexicon: DataFrame, endings: DataFrame, longest: int = 4) -> DataFrame:
    """``(word, tag)`` for a table of distinct ``word``: from the lexicon, else of the longest ending
    that was learned, else NN. No word is lost, and nothing runs while the plan is made."""
    known = words.join(lexicon, "word", "left")
    new = known.filter(F.col("tag").isNull()).select("word", F.explode(_endings(F.col("word"), longest)).alias("ending"))
    guessed = new.join(endings, "ending").groupBy("word").agg(F.max_by("tag", F.length("ending")).alias("_guess"))
    return known.join(guessed, "word", "left").select("word", F.coalesce("tag", "_guess", F.lit("NN")).alias("tag"))


def lemma_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "word string, class string, lemma string")


def with_lemmas(tagged: DataFrame, lemmas: DataFrame, spread: list[str]) -> DataFrame:
    """Lemma by word and tag class; a word without entry is its own lemma."""
    keyed = tagged.withColumn("_entry", F.concat_ws("/", F.lower("token"), tag_class("tag")))
    entries = lemmas.select(F.concat_ws("/", "word", "class").alias("_entry"), "lemma")
    joined = lookup_join(keyed, entries, "_entry", spread)
    return joined.withColumn("lemma", F.coalesce("lemma", F.lower("token"))).drop("_entry")


def lemma_of(word: Column, tag: Column) -> Column:
    """In-place lemma from the irregular forms."""
    entries = F.create_map(*[F.lit(x) for form, cls, lemma in LEMMAS for x in (f"{form}/{cls}", lemma)])
    lower = F.lower(word)
    irregular = lower.isin(sorted({form for form, _, _ in LEMMAS}))
    found = F.try_element_at(entries, F.concat_ws("/", lower, tag_class(tag)))
    return F.when(irregular, F.coalesce(found, lower)).otherwise(lower)


def lemmatize(tokens: Column | str, tags: Column | str) -> Column:
    return F.zip_with(_col(tokens), _col(tags), lemma_of)


def explain(tags: DataFrame, column: str = "tag") -> DataFrame:
    """Tags with their name in words (null when unknown)."""
    glossary = tags.sparkSession.createDataFrame(list(TAG_NAMES.items()), f"{column} string, meaning string")
    return tags.join(F.broadcast(glossary), column, "left")


def _letter(tag: str) -> str:
    return "D" if tag == "DT" else "J" if tag in ("JJ", "JJR", "JJS") else "N" if tag in NOUN_TAGS else "-"


def chunk_letters(tokens: Column | str) -> Column:
    """One letter a token: D for a determiner, J for an adjective, N for a noun, ``-`` for others.

    The letters of ``tag_tokens``, without the tags: only endings and words before that change the
    letter are looked at, and not whether a noun is proper.
    """
    known: dict[str, str] = {}
    for tag, words in WORD_TAGS.items():
        for w in words:
            known.setdefault(w, _letter(tag))
    endings = {e: "V" if tag in ("VBG", "VBD") else _letter(tag) for tag, ends in ENDING_TAGS.items() if tag != "NN" for e in ends}

    def of_known(lower: Column) -> Column:
        letter = lambda c: [w for w, x in known.items() if x == c]
        return F.when(lower.isin(letter("-")), "-").when(lower.isin(letter("D")), "D").when(lower.isin(letter("J")), "J").otherwise("N")

    def letters(lowers: Column) -> Column:
        def letter(lower: Column, i: Column) -> Column:
            first, before = F.substring(lower, 1, 1), F.get(lowers, i - 1)
            found = F.when(lower.isin(list(known)), of_known(lower)).when(
                ~first.between("a", "z") & (lower.rlike(SYMBOL) | (first.between("0", "9") & lower.rlike(NUMBER))), "-")
            for size in sorted({len(e) for e in endings}):
                tail = F.right(lower, F.lit(size))
                own = {c: [e for e, x in endings.items() if len(e) == size and x == c] for c in dict.fromkeys(endings.values())}
                each = None
                for c, ends in own.items():
                    if ends:
                        what = F.when(before.isin(AFTER_NOMINAL), "N").otherwise("-") if c == "V" else F.lit(c)
                        each = F.when(tail.isin(ends), what) if each is None else each.when(tail.isin(ends), what)
                found = found.when(tail.isin([e for e in endings if len(e) == size]), each)
            return found.when(before.isin(AFTER_VERBAL), "-").otherwise("N")
        return F.transform(lowers, letter)

    return let(F.transform(_col(tokens), F.lower), letters)


# Control characters written before a token: it opens a chunk, goes on with it, or stands outside.
OPENS, GOES_ON, OUTSIDE = "\u0002", "\u0001", "\u0003"


def noun_chunk_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Noun chunks ``(key, chunk_no, start, stop, chunk)``: determiner, adjectives, nouns.

    The tags become one letter per token; a determiner or adjective that leads to no noun is
    blanked, after which a letter and the one before it decide whether it opens a chunk. The
    tokens are then joined with their marks and the chunks cut out of that string: linear in the
    text, no shuffle, and no repeated group in a pattern (those recurse on long chunks).
    """
    def marked(words: Column) -> Column:
        codes = F.array_join(chunk_letters(words), "")
        settled = F.regexp_replace(F.regexp_replace(codes, "D(?!J*N)", "-"), "J(?!J*N)", "-")
        opened = F.regexp_replace(settled, "D|(?<![DJ])J|(?<![DJN])N", "O")

        def with_marks(letters: Column) -> Column:
            def piece(word: Column, i: Column) -> Column:
                letter = F.get(letters, i)
                return (F.when(letter == "-", OUTSIDE).when(letter == "O", F.concat(F.lit(OPENS), i.cast("string"), F.lit(":"), word))
                         .otherwise(F.concat(F.lit(GOES_ON), word)))
            return F.array_join(F.transform(words, piece), "")
        return let(F.split(opened, ""), with_marks)

    def cleaned(words: Column) -> Column:  # the marks must be ours alone
        ours = OPENS + GOES_ON + OUTSIDE
        return F.when(F.array_join(words, "").rlike(f"[{ours}]"), F.transform(words, lambda w: F.translate(w, ours, ""))).otherwise(words)

    clean = let(_col(tokens), cleaned)
    chunks = regex.all_matches(let(clean, marked), f"{OPENS}[^{OPENS}{OUTSIDE}]*")
    rows = df.select(key, F.posexplode(chunks).alias("chunk_no", "m"))
    start = F.regexp_extract("m", "^.([0-9]+):", 1).cast("int")
    words = F.split(F.regexp_replace("m", "^.[0-9]+:", ""), GOES_ON)
    return rows.select(key, "chunk_no", start.alias("start"), (start + F.size(words)).alias("stop"),
                       F.array_join(words, " ").alias("chunk"))


# A small gazetteer of multi-word and single names with their labels.
GAZETTEER = [
    ("hong kong", "GPE"), ("new york", "GPE"), ("st. louis", "GPE"), ("u.s.", "GPE"),
    ("apple", "ORG"), ("tesla", "ORG"), ("john lennon", "PERSON"), ("allen saunders", "PERSON"),
]
# Entity patterns and their labels.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ENTITY_PATTERNS = [
    ("MONEY", regex.MONEY),
    ("DATE", rf"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"),
    ("EMAIL", regex.EMAIL),
    ("URL", regex.URL),
]


def pattern_entities(df: DataFrame, key: str, text: str,
                     patterns: list[tuple[str, str]] = ENTITY_PATTERNS) -> DataFrame:
    """``(key, label, entity)`` for every pattern hit; no shuffle."""
    def labelled(label: str):
        return lambda match: F.struct(F.lit(label).alias("label"), match.alias("entity"))

    found = F.concat(*[F.transform(regex.all_matches(text, pattern), labelled(label))
                       for label, pattern in patterns])
    return df.select(key, F.explode(found).alias("e")).select(key, "e.label", "e.entity")


def name_entities(df: DataFrame, key: str, tokens: Column, names: DataFrame, longest: int = 3) -> DataFrame:
    """``(key, label, entity)`` for word sequences listed in a ``(phrase, label)`` table."""
    def grams(words: Column) -> Column:
        def starting(word: Column, i: Column) -> Column:
            rest = F.least(F.size(words) - i, F.lit(longest))
            return F.transform(F.sequence(F.lit(1), rest),
                               lambda n: F.array_join(F.slice(words, i + 1, n), " "))
        return F.flatten(F.transform(words, starting))

    phrases = df.select(key, F.explode(let(tokens, grams)).alias("entity"))
    phrases = phrases.withColumn("phrase", F.lower("entity"))
    hits = lookup_join(phrases, names, "phrase", [key], "inner")
    return hits.select(key, "label", "entity")


def gazetteer_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "phrase string, label string")
