"""SQL for vocabularies and TF-IDF weights."""

from oracle.views import WORD, half_even
from triagework.domain import ENGLISH_STOP_WORDS


def words(text: str, stop: bool) -> str:
    found = f"regexp_extract_all(lower({text}), '{WORD}{{2,}}')"
    if not stop:
        return found
    listed = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
    return f"list_filter({found}, lambda x: x not in ({listed}))"


def vocabulary_views(source: str, text: str, max_terms: int, min_docs: int, stop: bool) -> dict[str, str]:
    """Views ending in ``vocabulary(term, term_count, doc_count, term_index)``; ``source`` has ticket_key and split."""
    return {
        "words": f"select ticket_key, split, {words(text, stop)} as w from {source}",
        "counts": """
select ticket_key, split, term, count(*) as tf from (
  select ticket_key, split, unnest(w) as term from words
  union all
  select ticket_key, split, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words)
group by all""",
        "vocabulary": f"""
select term, term_count, doc_count, row_number() over (order by term) - 1 as term_index from (
  select term, cast(sum(tf) as bigint) as term_count, count(*) as doc_count from counts where split = 'train'
  group by term having count(*) >= {min_docs}
  order by term_count desc, term limit {max_terms})""",
    }


def weight_views(source: str, keep: list[str], sublinear: bool) -> dict[str, str]:
    """Views on top of ``vocabulary_views`` ending in ``weights(keep..., term, weight)``."""
    frequency = "(1 + ln(tf))" if sublinear else "tf"
    return {
        "raw": f"""
select ticket_key, term, {frequency} * (ln((1.0::double + (select count(*) from {source} where split = 'train'))
  / (1.0::double + doc_count)) + 1) as w
from counts join vocabulary using (term)""",
        "weights": f"""
select {', '.join('s.' + k for k in keep)}, term,
  {half_even('w / sqrt(sum(w * w) over (partition by ticket_key))', 6)} as weight
from raw join {source} s using (ticket_key)""",
    }
