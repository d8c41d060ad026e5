"""What surrounds an answer: the excerpts given to it, their numbers, and the events a reader of the stream sees.

The model that writes the answer, and web search, are the caller's; everything here is about rows and order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from .retrieval import citation_line, pack_context


def excerpts(hits: DataFrame, limit: int = fx.CONTEXT_CHARS) -> DataFrame:
    """(number, block) of a search's few hits in order of rank, up to the first that would pass ``limit`` letters."""
    numbered = hits.withColumn("number", F.row_number().over(Window.orderBy("rank")))
    block = F.concat(citation_line(F.col("number"), F.col("book"), F.col("title"), F.col("kind")), F.lit("\n"), "text", F.lit("\n"))
    return pack_context(numbered.withColumn("block", block), [], ["number"], F.char_length("block"), limit).select("number", "block")


def web_blocks(results: DataFrame, after: int, limit: int = fx.WEB_CONTEXT_CHARS) -> DataFrame:
    """(number, title, url, content) of web results, numbered on from the excerpts, packed likewise."""
    numbered = results.where(F.trim("content") != "").withColumn("number", F.row_number().over(Window.orderBy("position")) + after)
    packed = pack_context(numbered, [], ["number"], F.char_length("content"), limit)
    return packed.select("number", "title", "url", F.substring("content", 1, 600).alias("content"))


def standalone(question: Column, rewritten: Column, has_history: Column) -> Column:
    """The rewritten question if there was something to rewrite from and it is of a sensible length, else the question."""
    good = has_history & rewritten.isNotNull() & F.char_length(F.trim(rewritten)).between(1, 400)
    return F.when(good, F.trim(rewritten)).otherwise(question)


def events(sources: list[dict], answer: Iterable[str], web: Iterable[dict] | None = None, searched: bool = False) -> Iterator[tuple[int, str, object]]:
    """(seq, event, data) in the order a reader relies on: sources or fallback first, then searching and web_sources if the
    web was asked, tokens, and done or error at the end."""
    seq = 0

    def out(event: str, data: object) -> tuple[int, str, object]:
        nonlocal seq
        seq += 1
        return seq - 1, event, data

    yield out("sources", sources) if sources else out("fallback", None)
    if searched:
        yield out("searching", None)
        found = list(web or ())
        if found:
            yield out("web_sources", [{"index": len(sources) + n, **w} for n, w in enumerate(found, 1)])
    try:
        for token in answer:
            yield out("token", token)
    except Exception as e:  # what goes wrong in the caller's model ends the stream with an event
        yield out("error", str(e))
        return
    yield out("done", None)


def shown(dish_types: Column, ingredients: Column) -> dict[str, Column]:
    """What a source's card shows of its lists: the first two dish types and the first fifteen ingredients, null for an empty list."""
    text = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", "))
    return {"dishes": text(dish_types, fx.SHOWN_DISH_TYPES), "ingredients": text(ingredients, fx.SHOWN_INGREDIENTS)}
