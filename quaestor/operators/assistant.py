"""Questions and summaries for a language model that the caller brings: which texts it is given, and how it is asked.

``generate`` is a function of a prompt and a number of tokens; nothing here calls a service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from quaestor import api
from quaestor.bindings import Corpus

Generate = Callable[[str, int], str]


def summary_prompt(c: Corpus, doc_id: int, most: int = 12_000) -> str:
    """The prompt for a document's summary, with at most ``most`` characters of its text; ``LookupError`` if there is none."""
    row = c["texts"].filter(F.col("id") == doc_id).join(c["docs"].select("id", "title"), "id", "left").select("title", F.substring("text", 1, most).alias("text"), F.length("text").alias("n")).first()
    if row is None:
        raise LookupError(f"no document {doc_id}")
    cut = "" if row.n <= most else f"\n(The first {most} of {row.n} characters.)"
    return f"Summarise this document in three to five sentences. Name the people, organisations, dates and amounts that matter.\n\nTitle: {row.title or 'untitled'}{cut}\n\n{row.text}\n\nSummary:"


def summarize(c: Corpus, doc_id: int, generate: Generate, tokens: int = 512) -> str:
    return generate(summary_prompt(c, doc_id), tokens).strip()


def question_prompt(c: Corpus, question: str, documents: int = 5, around: int = 600) -> tuple[str, list[int]]:
    """The prompt for a question, with excerpts about its words from the documents that hold all of them, and their ids."""
    from quaestor.functions import search

    found = search.search_texts(c["texts"], question, phrase=False, k=documents)
    rows = found.join(c["texts"], F.col("doc_id") == F.col("id")).join(c["docs"].select("id", "title"), "id", "left").select("id", "title", "text", "score").orderBy(F.col("score").desc(), "id")
    first = max(question.split() or [""], key=len)
    parts = [(r.id, r.title, r.excerpt) for r in rows.select("id", "title", search.snippet(F.col("text"), first, around).alias("excerpt")).collect()]  # ``documents`` rows
    sources = "\n\n".join(f"[{k}] {title or 'untitled'} (document {i})\n{excerpt}" for k, (i, title, excerpt) in enumerate(parts, 1)) or "(no document holds these words)"
    return f"Answer from these excerpts alone, and cite them by number. Say so if they do not answer.\n\n{sources}\n\nQuestion: {question}\nAnswer:", [i for i, _, _ in parts]


def ask(c: Corpus, question: str, generate: Generate, tokens: int = 1024) -> tuple[str, list[int]]:
    """(answer, ids of the documents it was given)"""
    prompt, ids = question_prompt(c, question)
    return generate(prompt, tokens).strip(), ids
