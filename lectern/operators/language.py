"""Language of pages: sampled lines, scored models, and letter and word statistics of text.

A text's script comes first: the one that most of its letters belong to. Within a
script, letters that only one language has decide; in Latin script the language
with the most frequent words does. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_LINES = 3
FALLBACK = "english"
#: Languages that are candidates for every model.
ALWAYS = ("english", "chinese")
#: Share of letters that a script needs; kana need less, as they stand among Chinese letters.
SCRIPT_SHARE, KANA_SHARE = 0.3, 0.05

# Frequent short words of languages in Latin script.
COMMON = {
    "english": "the of and to in is that it was for on are with as by be this",
    "french": "le la les de des et est un une que qui dans pour par sur au du en",
    "german": "der die das und ist von zu den mit sich des auf für im nicht ein eine als",
    "spanish": "el la los las de que y en un una por con para es del se al no su",
    "italian": "il la di che e un una per non sono con le del dei della in si",
    "portuguese": "o a os as de que e em um uma para com não do da no na por",
    "dutch": "de het een en van in is dat op te met voor niet zijn aan er",
    "swedish": "och att det som en på är av för med till den har inte om ett",
    "danish": "og at det som en på er af for med til den har ikke om et",
    "finnish": "ja on ei se että oli hän mutta kun niin ovat tai myös",
    "polish": "i w z na do się nie to że jest o jak po przez",
    "turkish": "ve bir bu için ile da de çok daha gibi ne kadar",
    "bokmal": "og i det som er på til av jeg ikke hvordan fra eller også noe",
    "nynorsk": "og i det som er på til av eg ikkje korleis frå eller òg noko",
    "icelandic": "og að það sem er í á við ekki til hann þetta eða með",
    "catalan": "el la els les i de que és amb per una no aquest també més",
    "romanian": "și de la în cu pe nu este care sunt din mai pentru o ce",
    "latin": "et in est non ad cum ut quod sed qui ex atque enim esse",
    "czech": "a se na je že s to v z do pro jako ale byl který",
    "slovak": "a sa na je že s to v z do pre ako ale bol ktorý",
    "croatian": "i je u da se na za su od što kao ili bi iz",
    "slovene": "in je da se na za so od kot ali bi iz pa tudi",
    "hungarian": "a az és hogy nem is egy ez van meg de mint volt",
    "estonian": "ja on ei see et oli ta kui ning oma mis ka või",
    "latvian": "un ir ar no par ka tas uz kā bet arī vai pie",
    "lithuanian": "ir yra su iš kad tai į bet kaip arba buvo taip",
    "albanian": "dhe të në që një me për nuk është nga si më",
    "basque": "eta da ez du bat dira hau baina ere izan zen dute",
    "welsh": "y yr yn a mae ei ac o i ar am oedd gan",
    "irish": "an agus na ar is i le go tá sé bhí níl ag",
    "indonesian": "yang dan di ini itu dengan untuk tidak dari dalam akan pada",
    "malay": "yang dan di ini itu dengan untuk tidak daripada dalam akan kepada",
    "vietnamese": "là và của không có một cho được với các này trong",
    "tagalog": "ang ng sa mga na at ay ito si hindi para kung",
    "swahili": "na ya wa kwa ni katika la za hii kama si cha",
    "esperanto": "la kaj de estas en al ne mi vi por kun tiu",
    "afrikaans": "die en van is in het dat nie vir op met ek",
    "azerbaijani": "və bir bu üçün ilə də çox daha kimi nə olan",
    "somali": "iyo ka ku waa in oo la uu ayaa waxaa si",
    "yoruba": "ni ti àwọn sí tí wọ́n fún pé náà kan jẹ́",
    "zulu": "ukuthi futhi kodwa uma ngoba yebo cha lapho manje",
}
# First and last letter of scripts, with the language that each stands for by itself.
SCRIPTS = (
    ("russian", 0x0400, 0x04FF), ("greek", 0x0370, 0x03FF), ("arabic", 0x0600, 0x06FF), ("hebrew", 0x0590, 0x05FF), ("hindi", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gujarati", 0x0A80, 0x0AFF), ("punjabi", 0x0A00, 0x0A7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("armenian", 0x0530, 0x058F), ("japanese", 0x3040, 0x30FF), ("korean", 0xAC00, 0xD7AF), ("chinese", 0x4E00, 0x9FFF),
)
# Letters that tell other languages of a script, the first found decides.
OWN_LETTERS = (
    ("russian", "belarusian", "ўЎ"), ("russian", "ukrainian", "їєґЇЄҐ"), ("russian", "macedonian", "ѓќѕЃЌЅ"), ("russian", "serbian", "љњђћјЉЊЂЋЈ"),
    ("russian", "kazakh", "әғқңұһӘҒҚҢҰҺ"), ("russian", "mongolian", "өүӨҮ"),
    ("arabic", "urdu", "ٹڈڑےں"), ("arabic", "persian", "پچژگ"), ("hindi", "marathi", "ळ"),
)
#: What may stand before or after a word.
EDGES = ".,;:!?()\"'"


# Fixed values of the sample: places are taken in the order of place * 7919 modulo 10007.
_STEP, _RING = 7919, 10007


def sampled_places(n_lines: int, n: int = SAMPLE_LINES) -> list[int]:
    """Places of the lines of a page that are sampled: all of a short page, else some that are spread over it."""
    return sorted(sorted(range(n_lines), key=lambda place: (place * _STEP % _RING, place))[:n])


def sample_lines(lines: DataFrame, keys: list[str], n: int = SAMPLE_LINES) -> DataFrame:
    """At most n lines a page, as ``sampled_places`` draws them by place in ``ord``: the feature is a sample."""
    rows = lines.withColumn("_place", (F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1).cast("bigint"))
    order = Window.partitionBy(*keys).orderBy(F.col("_place") * _STEP % _RING, "_place")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "_place")


def mean_score(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_file, score): mean over samples; one without a score counts as 0."""
    return samples.groupBy(*keys, "model_file").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))


def best_model(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_file, score): the best score; of equal ones the first file name."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "model_file")
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def candidates(languages: Column) -> Column:
    """A model's languages, then those that are always candidates."""
    return F.array_union(languages, F.array(*map(F.lit, ALWAYS)))


def _count(letters: Column, low: int, high: int) -> Column:
    return F.char_length(F.regexp_replace(letters, f"[^\\x{{{low:04X}}}-\\x{{{high:04X}}}]", ""))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _by_words(text: Column) -> Column:
    """The language in Latin script with the most frequent words; English without any."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, f"^[{EDGES}]+|[{EDGES}]+$", ""))
    known = F.filter(words, lambda w: w.isin(*sorted({w for common in COMMON.values() for w in common.split()})))

    def most(found: Column) -> Column:
        count = lambda common: F.size(F.filter(found, lambda w: w.isin(*common.split())))
        scores = (
            F.struct(count(common).alias("n"), F.lit(name == FALLBACK).alias("first"), F.lit(-k).alias("place"), F.lit(name).alias("name"))
            for k, (name, common) in enumerate(COMMON.items())
        )
        return F.array_max(F.array(*scores))["name"]

    return _let(known, lambda found: F.when(F.size(found) > 0, most(found)).otherwise(FALLBACK))


def detect(text: Column) -> Column:
    """The most likely language of a text by script, letters and frequent words; null without a letter.

    Of scripts with as many letters the first counts; of languages with as many
    words English, then the first; without any such word a text is in English.
    """
    kana = next(k for k, s in enumerate(SCRIPTS) if s[0] == "japanese")

    def by_script(letters: Column) -> Column:
        counts = F.array(*(F.struct(_count(letters, low, high).alias("n"), F.lit(-k).alias("place"), F.lit(name).alias("name")) for k, (name, low, high) in enumerate(SCRIPTS)))
        n = F.char_length(letters)

        def chosen(found: Column) -> Column:
            script = F.array_max(found)
            own = script["name"]
            for base, name, signs in reversed(OWN_LETTERS):
                own = F.when((script["name"] == base) & text.rlike(f"[{signs}]"), name).otherwise(own)
            return F.when(found[kana]["n"] > KANA_SHARE * n, "japanese").when(script["n"] > SCRIPT_SHARE * n, own).otherwise(_by_words(text))

        foreign = F.regexp_replace(letters, r"[\x{0041}-\x{024F}]", "") != ""  # else all letters are Latin
        return F.when(n > 0, F.when(foreign, _let(counts, chosen)).otherwise(_by_words(text)))

    return _let(F.regexp_replace(text, r"[^\p{L}]", ""), by_script)


def detected(text: Column, among: Column) -> Column:
    """The language of a text if it is a candidate, else the first candidate.

    This is a small scorer of our own, which stands in for a trained detector.
    """
    found = detect(text)
    return F.when(F.array_contains(among, found), found).otherwise(F.element_at(among, 1))


def language_of_text(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """pages with language (fallback English), confidence 1 and error_kind for empty text."""
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return pages.withColumns({
        "language": F.when(~empty, F.coalesce(detect(F.col(text)), F.lit(FALLBACK))),
        "confidence": F.when(~empty, F.lit(1.0)),
        "error_kind": F.when(empty, F.lit("InferenceError")),
    })


def document_language(pages: DataFrame, requested: str = "requested", found: str = "found") -> DataFrame:
    """(doc_id, page_number, language): the requested one, else the first that a page found.

    Pages before the one that needed detection have none.
    """
    upto = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("language", F.coalesce(requested, F.first(found, ignorenulls=True).over(upto))).select("doc_id", "page_number", "language")


def language_of_samples(samples: DataFrame, groups: DataFrame, keys: list[str], identify=None) -> DataFrame:
    """(keys, language, model_file, confidence) from lines that each script model has read.

    samples has model_file, ord, text and score. The model with the best mean
    score wins; the language is detected in its texts among its languages and
    those that are always candidates, by ``identify(rows, text, among)``, which adds a
    column ``found``, or by ``detected``.
    """
    best = best_model(mean_score(samples, keys), keys)
    texts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text"))))
    read = samples.groupBy(*keys, "model_file").agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("_text"))
    rows = best.join(read, [*keys, "model_file"]).join(F.broadcast(groups), "model_file")
    rows = rows.withColumn("_among", candidates(F.col("languages")))
    rows = identify(rows, "_text", "_among") if identify else rows.withColumn("found", detected(F.col("_text"), F.col("_among")))
    return rows.select(*keys, F.col("found").alias("language"), "model_file", F.col("score").alias("confidence"))
