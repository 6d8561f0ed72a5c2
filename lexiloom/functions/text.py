"""Text to sentences to tokens, as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of a token split, and what may stand at a token's edge.
SPACE = r"[ \t\n\x0B\f\r]"
CORE = r"\p{L}\p{Nd}'"
#: What is left of a run without white space once its edges are stripped: runs of CORE with others between, without backtracking.
TOKEN = rf"[{CORE}]++(?:[^ \t\n\x0B\f\r{CORE}]++[{CORE}]++)*+"


def regex_sentences(text: Column) -> Column:
    """Split after . ! or ? where white space follows."""
    return F.split(text, rf"(?<=[.!?]){SPACE}+", -1)


def tokens(sentence: Column) -> Column:
    """Lower-case tokens in order: runs without white space, less what is no letter, digit or apostrophe at their edges. One
    pass over the sentence finds them all."""
    return F.transform(F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def seed_words(seed: Column) -> Column:
    """A seed text's words, trimmed and lower-cased."""
    return F.filter(F.transform(F.split(F.trim(seed), f"{SPACE}+", -1), lambda t: F.lower(t)), lambda t: t != "")


def rendered(words: Column) -> Column:
    return F.array_join(words, " ", "?")


def rendered_length(sentence: Column) -> Column:
    """Words of a rendered sentence; an empty one counts as one."""
    return F.size(F.split(sentence, f"{SPACE}+", -1)).cast("long")


def packed_key(a: Column, b: Column) -> Column:
    """Two 32-bit ids in one 64-bit key."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def positions(last: Column) -> Column:
    """0, 1, .. last; none if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def ngram_rows(sents: DataFrame, n: int) -> DataFrame:
    """w1 .. wn, is_end: a row for each run of n tokens in a sentence (.., toks); is_end marks the last. Positions are exploded, and
    words taken from the sentence afterwards, so no array of structs is made; short sentences aren't filtered, as that would cut
    them a second time."""
    size = F.size("toks")
    at = sents.select("toks", F.explode(positions(size - n)).alias("i"))
    return at.select(*[F.get("toks", F.col("i") + k).alias(f"w{k + 1}") for k in range(n)], (F.col("i") + n == size).alias("is_end"))


def regex_sentence_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent, toks): a row per sentence that has a token; sent counts the pieces of the text from 0."""
    rows = docs.select(key, F.posexplode(regex_sentences(F.col(text))).alias("sent", "s"))
    # Asked of the sentence, as a filter on its tokens would cut it a second time.
    return rows.filter(F.col("s").rlike(f"[{CORE}]")).select(key, "sent", tokens(F.col("s")).alias("toks"))


#: Classes of characters in the JDK's sentence rules, as fixed values: spaces, terminators, full stops, closing marks, quotes,
#: dandas. Combining marks and format characters count with what stands before them. OTHER is what is in none of these and no
#: letter, digit or comma.
_SPACES, _TERM, _STOP, _CLOSE, _QUOTE, _DANDA = r"\p{Zs}\t\n\f\r\x{2028}", "!?。！？", ".．", r"\p{Pe}\p{Pf}", "\"'", r"\x{0964}\x{0965}"
_MARKS = r"\p{Mn}\p{Me}\p{Cf}"
_NOT_OTHER = rf"\p{{L}}\p{{N}},{_SPACES}\x{{2029}}{_TERM}{_STOP}{_CLOSE}{_MARKS}"


def _of(chars: str) -> str:
    return f"(?:[{chars}][{_MARKS}]*)"


def jdk_breaks() -> str:
    """The JDK's sentence rules for US English as one pattern without look-around, for Java and for RE2: a sentence ends
    behind groups 1, 2, 4, 6 and 8, and groups 3, 5, 7 and 9 are what had to be seen behind that end.

    A run that begins with a terminator ends a sentence with its closing marks and spaces, and so do a paragraph separator
    and a danda. A run that begins with a full stop does so by what follows: after spaces a letter that isn't lower case, or
    any letter behind other signs; after two spaces, or a quote, any letter; with no space, other signs and then a letter.
    A single other sign or quote behind a quote or two spaces ends one too, whatever comes next."""
    space, stop, letter = _of(_SPACES), _of(_STOP) + _of(_STOP + _CLOSE + _QUOTE) + "*", _of(r"\p{L}")
    other, sign = _of(f"^{_NOT_OTHER}{_QUOTE}"), _of(f"^{_NOT_OTHER}")
    return "|".join(
        [
            rf"({_of(_TERM)}{_of(_TERM + _STOP + _CLOSE + _QUOTE)}*{space}*\x{{2029}}?|\x{{2029}}|{_of(_DANDA)}{space}*)",
            f"({stop}{space}+)({sign}+{letter}|{_of('\\p{Lu}\\p{Lt}\\p{Lo}\\p{Lm}')})",
            f"({stop}(?:{space}{space}+|{_of(_QUOTE)}))({letter})",
            f"({stop})({other}{sign}*{letter})",
            f"({_of(_STOP)})({_of(_STOP + _CLOSE + _QUOTE)}*(?:{_of(_QUOTE)}{other}|{space}{space}+{sign})[{_NOT_OTHER}])",
        ]
    )


#: What parts sentences while they are cut; in a text itself it counts as the character after it.
CUT = "\x01"


def jdk_sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.translate(text, CUT, "\x02"), jdk_breaks(), f"$1$2$4$6$8{CUT}$3$5$7$9")
    return F.split(marked, CUT, -1)


def jdk_sentence_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent, toks) by the JDK's sentence rules for US English: a row per sentence that has a token; sent counts these
    from 0. Plain expressions without a shuffle; rows that repeat stay apart. One case differs: a danda in the run behind a
    full stop ends a sentence even before a digit."""
    cut = F.filter(F.transform(jdk_sentences(F.col(text)), tokens), lambda t: F.size(t) > 0)
    return docs.select(key, F.posexplode(cut).alias("sent", "toks"))
