"""Text cleaning, text statistics, tokens and terms, all as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagework.domain import PROBLEM_WORDS, URGENCY_WORDS

# Unicode white space, as a regex class body (in a pattern that starts with UNICODE) and as plain characters.
UNICODE = "(?U)"
SPACE = r"\s\x1c-\x1f"
SPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000],
    )
)
LETTER = r"\p{L}\p{N}_"

TAG = r"<[^>]+>"
URL = rf"{UNICODE}https?://[^{SPACE}]+|www\.[^{SPACE}]+"
NOT_LETTERS = rf"{UNICODE}[^a-zA-Z{SPACE}']+"
WORD = f"{UNICODE}[^{SPACE}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def clean_light(text: Column) -> Column:
    """Lower case without tags and URLs; digits, punctuation and accents stay."""
    return strip(_without_markup(text))


def clean_strict(text: Column) -> Column:
    """Lower case without tags and URLs; only letters, white space and apostrophes stay."""
    return strip(F.regexp_replace(_without_markup(text), NOT_LETTERS, ""))


def _without_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), TAG, ""), URL, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def model_text(category: Column, subject: Column, description: Column) -> Column:
    """One text of category, subject and description, each introduced by its name."""
    empty = F.lit("")
    return F.concat(
        F.lit("category "), F.coalesce(category, empty),
        F.lit(" subject "), F.coalesce(subject, empty),
        F.lit(" description "), F.coalesce(description, empty),
    )


def resolution_text(subject: Column, description: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(subject, empty), F.lit(" "), F.coalesce(description, empty))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def count_whole_words(text: Column, words: list[str]) -> Column:
    return count_of(text, rf"(?<![{LETTER}])({'|'.join(words)})(?![{LETTER}])")


def text_statistics(subject: Column, description: Column) -> dict[str, Column]:
    """Lengths, word counts and punctuation counts of a ticket's two texts."""
    empty = F.lit("")
    return {
        "Subject_Length": F.char_length(F.coalesce(subject, empty)),
        "Description_Length": F.char_length(F.coalesce(description, empty)),
        "Subject_Word_Count": word_count(subject),
        "Description_Word_Count": word_count(description),
        "Exclamation_Count": count_of(description, "!"),
        "Question_Count": count_of(description, r"\?"),
    }


def strict_statistics(subject: Column, description: Column) -> dict[str, Column]:
    """The seven numeric features of strictly cleaned texts."""
    return {
        **text_statistics(subject, description),
        "Problem_Word_Count": count_whole_words(description, PROBLEM_WORDS),
    }


def light_statistics(subject: Column, description: Column) -> dict[str, Column]:
    """The seven numeric features of lightly cleaned texts."""
    return {
        **text_statistics(subject, description),
        "Urgency_Word_Count": count_whole_words(F.lower(description), URGENCY_WORDS),
    }


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words of at least two letters, digits or underscores, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{LETTER}]{{2,}}"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(stop_words))
    return words


def one_and_two_grams(words: Column) -> Column:
    """The words followed by each pair of neighbouring words."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    firsts, seconds = F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs)
    return F.concat(words, F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b)))
