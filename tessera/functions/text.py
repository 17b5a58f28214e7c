"""Text columns: tokens, patterns, query and prompt forms. Patterns avoid look-behind, which some engines lack."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words and phrases that results depend on
GENRES = ["rock", "pop", "jazz", "blues", "country", "folk", "hip hop", "hip-hop", "rap", "r&b", "soul", "funk", "disco", "electronic", "edm", "house", "techno", "trance", "dubstep", "drum and bass", "ambient", "classical", "metal", "punk", "indie", "alternative", "reggae", "ska", "latin", "salsa", "bossa nova", "world", "gospel", "musical", "soundtrack", "k-pop", "j-pop", "bollywood", "afrobeat"]
MOODS = ["chill", "relax", "relaxing", "calm", "mellow", "soothing", "sad", "melancholy", "melancholic", "happy", "joyful", "cheerful", "upbeat", "energetic", "energizing", "uplifting", "dark", "moody", "angry", "aggressive", "intense", "dramatic", "romantic", "love", "sexy", "sensual", "dreamy", "ethereal", "nostalgic", "epic"]
INSTRUMENTS = ["guitar", "piano", "violin", "drums", "bass", "saxophone", "sax", "trumpet", "synth", "synthesizer", "vocals", "vocal", "acoustic", "electric", "cello", "flute", "harp", "harmonica", "banjo", "ukulele", "organ", "keyboard", "strings"]
DECADES = {"forties": 1940, "fifties": 1950, "sixties": 1960, "seventies": 1970, "eighties": 1980, "nineties": 1990}
FILLER = (
    r"can you|could you|would you|please|i want|i'd like|i would like|"
    r"i need|i'm looking for|i am looking for|something that(?:'s| is)|something|"
    r"recommend(?:ation)?|suggest(?:ion)?|play(?: me)?|find me|show me|give me|"
    r"how about|what about|i feel like(?: listening to)?|i(?:'m| am) in the mood for|"
    r"do you have|do you know"
)
POSITIVE = (
    r"yes\b|yeah|yep|perfect|exactly|that'?s (it|exactly|right|perfect)|love (it|this)|"
    r"great (choice|pick|selection)?|awesome|fantastic|excellent|found (it|what)|"
    r"keep (going|them coming|it up)|more like (this|that)|that'?s the (one|song|track)|"
    r"this is (perfect|it|exactly)|that is (perfect|it|exactly)"
)
NEGATIVE = (
    r"not (quite|really|this|that|it)|something (different|else|more|other)|"
    r"try (something|another|a different)|rather (have|get|hear)|instead|"
    r"don'?t (want|like|think)|that'?s not|not what i|too (slow|fast|heavy|light|pop|dark|upbeat|sad|old|new)|"
    r"i was (thinking|hoping|looking for)|i'?m (looking for|hoping for|thinking more)"
)
NEGATION = (
    r"not what|not quite|not really|not exactly|doesn't|don't|didn't|"
    r"isn't|wasn't|that's not|but i(?:'m| am)|but i want|but i(?:'d| would)|"
    r"too much|too little|wrong|different|instead|rather|no[,.]|nope|"
    r"not the|without|less|more of a|looking for something"
)
FOLLOWUP = (
    r"more like|more of|another|similar|same|again|keep|continue|"
    r"along those lines|in that vein|that direction|like that|"
    r"the same|one more|next|also|too"
)
PIVOT = (
    r"break away|branch out|move on|move away|get away from|move past|"
    r"switch (it|things) up|change (it|things) up|mix (it|things) up|"
    r"something (different|else|new)|different (artist|band|sound|style|direction|vibe|genre|phase)|"
    r"new (\w+ ){0,3}(artist|band|artists|bands)|other (artist|artists|bands)|"
    r"(discover|find|explore|hoping for|looking for)( a| an| some)? new\b|"
    r"tired of|sick of|bored of|enough of|done with|move beyond|"
    r"stop (giving|playing|recommending|with)|no more|"
    r"not (this|that|what|really what|looking for more|interested)|"
    r"(this|that)('| i)?s? (is)?\s?n[o']t (what|it|right|working)|"
    r"isn'?t what i|don'?t want (more|another|any more)|"
    r"away from|instead of|rather than|other than|besides|"
    r"discover (new|other|different)|explore (new|other|different)"
)
LYRICS = ["lyrics", "meaning", "sing", "words", "sung", "singing"]
SIMILAR = ["like this", "similar", "more like", "same vibe", "another one", "like that"]
MOOD_WORDS = ["sad", "happy", "chill", "energetic", "calm", "party", "sleep", "study", "workout", "mellow", "upbeat", "melancholy", "romantic", "angry", "nostalgic", "dreamy", "relaxing", "soft", "hard", "loud", "quiet", "intense", "dark", "bright", "cheerful"]
POOL_WORDS = {"specific": ["who sings", "song by", "track by", "by ", "any songs by"], "lyrics": ["lyric", "lyrics", "the line", "the words"], "more_like_this": ["more like", "similar to", "like this", "more of"], "mood": ["mood", "vibe", "feel", "feeling", "chill", "upbeat", "sad", "happy"]}
MOVES, DOES_NOT = "MOVES_TOWARD_GOAL", "DOES_NOT_MOVE_TOWARD_GOAL"

#: a word's edges as classes, which Java's and other engines' patterns read alike
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
KEY_L, KEY_R = "(^|[^a-z0-9])", "([^a-z0-9]|$)"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def ascii_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def normal(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and spaces to a space, runs of spaces to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def mention_pattern(phrases: str) -> str:
    """Whole words, in any case; an edge takes no character, so phrases that follow one another are all found."""
    return rf"(?i)\b({phrases})\b"


def mentions(text: Column, phrases: str) -> Column:
    return F.coalesce(text.rlike(mention_pattern(phrases)), F.lit(False))


def without_filler(text: Column) -> Column:
    """Filler phrases out; a text that is nothing else stays."""
    left = F.regexp_replace(text, mention_pattern(FILLER), " ")
    left = F.trim(F.regexp_replace(left, r"\s+", " "))
    return F.coalesce(F.nullif(left, F.lit("")), text)


def feedback(text: Column) -> Column:
    return F.when(mentions(text, POSITIVE), MOVES).when(mentions(text, NEGATIVE), DOES_NOT).otherwise("")


def keyword_pattern(word: str) -> str:
    return KEY_L + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in word) + KEY_R


def keyword_count(text: Column, keywords: list[str]) -> Column:
    """Different keywords found as whole words; matches may overlap."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # words of letters and digits are parts between all other characters: the text is cut once for all of them
    plain = [k for k in keywords if re.fullmatch("[a-z0-9]+", k)]
    total = F.size(F.array_intersect(F.split(low, "[^a-z0-9]+"), F.array(*map(F.lit, plain)))) if plain else F.lit(0)
    for k in keywords:
        if k not in plain:
            total = total + (low.contains(k) & low.rlike(keyword_pattern(k))).cast("int")
    return total


#: where an era is found, in order of priority
RANGE = r"\b(19[0-9][0-9]|20[0-2][0-9])\s*[-–to]+\s*(19[0-9][0-9]|20[0-2][0-9])\b"
TENS = r"\b(19[2-9]0|20[0-2]0)s?\b"
SHORT = r"\b([2-9]0)s\b"
YEAR = r"\b(19[2-9][0-9]|20[0-2][0-9])\b"


def era(text: Column) -> Column:
    """struct(found, centre, lo, hi): a range, a decade's name, a decade, a short decade, a year; the first of these that is found."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pick = lambda p, g: F.nullif(F.regexp_extract(low, p, g), F.lit("")).cast("int")
    a, b = pick(RANGE, 1), pick(RANGE, 2)
    named = F.coalesce(*[F.when(low.contains(w), F.lit(y)) for w, y in DECADES.items()])
    ten = F.coalesce(named, pick(TENS, 1), F.lit(1900) + pick(SHORT, 1))
    year = pick(YEAR, 1)
    lo, hi = F.coalesce(F.least(a, b), ten, year), F.coalesce(F.greatest(a, b), ten + 9, year)
    return F.struct(lo.isNotNull().alias("found"), F.coalesce((lo + hi) / 2, F.lit(0.0)).alias("centre"), lo.alias("lo"), hi.alias("hi"))


def audit_bucket(text: Column, n_history: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: low.contains(w))
    spaced = F.split(low, r"\s+")
    tokens = F.split(low, r"[^\p{L}\p{N}_]+")
    return F.when(has(SIMILAR), "more_like_this").when(F.arrays_overlap(spaced, F.array(*map(F.lit, LYRICS))), "lyrics").when(F.coalesce(text, F.lit("")).rlike(r'(?i)"[^"]+"|' + EDGE_L + r"by\s+[\p{L}\p{N}_]+"), "specific").when(F.arrays_overlap(tokens, F.array(*map(F.lit, MOOD_WORDS))), "mood").when(n_history >= 2, "history_driven").otherwise("generic")


def pool_bucket(text: Column, has_history: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, keys in POOL_WORDS.items():
        out = out.when(F.exists(F.array(*map(F.lit, keys)), lambda w: low.contains(w)), name)
    return out.when(has_history, "history_driven").otherwise("generic")


def first_sentence(text: Column, limit: int = 200) -> Column:
    at = F.instr(text, ". ")
    return F.when((at > 0) & (at < limit), F.substring(text, F.lit(1), at)).otherwise(F.substring(text, 1, limit))


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def budgeted(parts: Column, budget: int, size, joiner: str = " ") -> Column:
    """Parts from the first on while they fit the budget; one that doesn't fit is passed over."""
    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc, p):
        fits = acc["used"] + size(p) <= budget
        return F.struct((acc["used"] + F.when(fits, size(p)).otherwise(0)).cast("int").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"))

    return F.array_join(F.aggregate(parts, start, step)["kept"], joiner)
