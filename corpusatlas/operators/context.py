"""Related text of a file, and prompts with a size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.functions import text
from corpusatlas.operators import graph
from corpusatlas.operators.manifest import context_kind
from corpusatlas.operators.ordered import numbered, running
from corpusatlas.operators.skew import ROWS_PER_SPLIT, salted_join
from corpusatlas.session import materialise, materialise_counted

_ORDER = ["source", "place"]
#: Characters of a piece of a context that is kept in rows.
PIECE_CHARS = 1 << 20

PROMPT = (
    "Main file\n"
    "Name: {name}\n"
    "Content:\n{content}\n\n"
    "Related files:\n{related}\n\n"
    "Compiled text:\n{compiled}\n"
)
_SLOTS = ("name", "content", "related", "compiled")


def sizes(contents: DataFrame) -> DataFrame:
    """Characters and tokens of every file: one scan of the texts, kept as a table."""
    content = F.col("content")
    return materialise(
        contents.select(
            "abs_path",
            F.length(content).cast("bigint").alias("n_chars"),
            text.token_count(content).alias("n_tokens"),
        ),
        "sizes",
    )


def placed_texts(
    pieces: DataFrame,
    contents: DataFrame,
    file_sizes: DataFrame,
    split_owners: bool,
    limit: int | None = None,
    cut: int = text.CUT_CHARS,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """`(owner, source, place, text, n_tokens)`: the texts of `(owner, source, place, piece)` rows that an owner gets.

    Sizes come first, texts last. Without a `limit` an owner gets its whole text, and so
    it does up to `limit` tokens. Beyond it only the first `cut` characters can reach a prompt, so pieces starting
    later are left out before any text moves; `n_tokens` still counts all of them.
    `split_owners` is for owners that may have any number of pieces. Otherwise the
    pieces of an owner come from its own text and fit one task as that text did.
    """
    limit = (1 << 63) - 1 if limit is None else limit
    pieces, n_pieces = materialise_counted(pieces, "pieces")
    measured = salted_join(
        pieces,
        file_sizes.withColumnRenamed("abs_path", "piece"),
        ["piece"],
        "left",
        spread_by=["owner", *_ORDER],
        at_most=n_pieces,
        rows_per_split=rows_per_split,
    ).select(
        "owner",
        *_ORDER,
        "piece",
        (F.coalesce("n_chars", F.lit(0)) + 1).alias("_chars"),
        F.coalesce("n_tokens", F.lit(0)).alias("_tokens"),
    )
    if split_owners:
        placed = running(
            measured,
            ["owner"],
            _ORDER,
            {"_end": ("sum", F.col("_chars")), "_all": ("sum", F.col("_tokens"))},
            totals=["_all"],
            at_most=n_pieces,
            rows_per_task=rows_per_split,
        )
    else:
        whole = Window.partitionBy("owner")
        upto = whole.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = measured.withColumns(
            {
                "_end": F.sum("_chars").over(upto),
                "_all_total": F.sum("_tokens").over(whole),
            }
        )
    start = F.col("_end") - F.col("_chars")
    # A piece that starts right at the cut is empty, but the line end before it counts.
    kept = placed.withColumn("_left", F.lit(cut) - start).where(
        (F.col("_all_total") <= limit) | (F.col("_left") >= 0)
    )
    texts = contents.select(F.col("abs_path").alias("piece"), "content")
    body = F.coalesce("content", F.lit(""))
    if n_pieces > rows_per_split:
        kept = materialise(kept, "kept")
    filled = salted_join(
        kept,
        texts,
        ["piece"],
        "left",
        spread_by=["owner", *_ORDER],
        at_most=n_pieces,
        rows_per_split=rows_per_split,
    ).withColumn(
        "_text",
        F.when(
            F.col("_all_total") > limit, F.substring(body, F.lit(1), F.col("_left").cast("int"))
        ).otherwise(body),
    )
    return filled.select("owner", *_ORDER, F.col("_text").alias("text"), F.col("_all_total").alias("n_tokens"))


def gather(pieces: DataFrame, contents: DataFrame, file_sizes: DataFrame, split_owners: bool, **limits) -> DataFrame:
    """`(owner, related, n_tokens)`: the texts of `placed_texts` joined, one line end between."""
    filled = placed_texts(pieces, contents, file_sizes, split_owners, **limits)
    ordered = F.array_sort(F.collect_list(F.struct(*_ORDER, "text")))
    return filled.groupBy("owner").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("related"),
        F.first("n_tokens").alias("n_tokens"),
    )


def in_pieces(
    pieces: DataFrame, contents: DataFrame, file_sizes: DataFrame, split_owners: bool = True,
    piece_chars: int = PIECE_CHARS, **limits,
) -> DataFrame:
    """`(owner, piece_no, text, n_tokens)`: the joined text of `gather` in numbered rows of bounded size.

    An owner may have any amount of text, because it is never one row; put together in order, its
    pieces are the text that `gather` gives. An owner whose text is empty has no piece.
    """
    filled = materialise(placed_texts(pieces, contents, file_sizes, split_owners, **limits), "context")
    first = filled.groupBy("owner").agg(F.min(F.struct(*_ORDER)).alias("_first")).select(F.col("owner").alias("_owner"), "_first")
    marked = salted_join(
        filled, first.withColumnRenamed("_owner", "owner"), ["owner"], "inner", spread_by=["owner", *_ORDER]
    )
    begins = F.struct(*_ORDER) == F.col("_first")
    whole = F.when(begins, F.col("text")).otherwise(F.concat(F.lit("\n"), "text"))
    n_cuts = F.ceil(F.length("_whole") / F.lit(piece_chars)).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(0), n_cuts - 1), lambda i: F.substring(F.col("_whole"), i * piece_chars + 1, F.lit(piece_chars))
    )
    rows = marked.withColumn("_whole", whole).where(F.length("_whole") > 0).select(
        "owner", *_ORDER, "n_tokens", F.posexplode(cuts).alias("_cut", "text")
    )
    numbered_rows = numbered(rows, ["owner"], [*_ORDER, "_cut"], "_n")
    return numbered_rows.select("owner", (F.col("_n") - 1).alias("piece_no"), "text", "n_tokens")


def code_context(
    edges: DataFrame, contents: DataFrame, file_sizes: DataFrame, **limits
) -> DataFrame:
    """Text of everything a code file imports inside its repository."""
    return gather(graph.code_pieces(edges), contents, file_sizes, split_owners=False, **limits)


def template_context(
    edges: DataFrame, manifest: DataFrame, contents: DataFrame, file_sizes: DataFrame, **limits
) -> DataFrame:
    """Text of the code files that name a template, and of their styles."""
    pieces = graph.template_pieces(edges, manifest)
    return gather(pieces, contents, file_sizes, split_owners=True, **limits)


def prompts(
    files: DataFrame,
    edges: DataFrame,
    manifest: DataFrame,
    wanted: DataFrame | None = None,
    contents: DataFrame | None = None,
    limit: int = text.TOKEN_LIMIT,
    cut: int = text.CUT_CHARS,
) -> DataFrame:
    """One prompt per file of `(repo, path, abs_path, ext, content)`.

    Tokens are counted per file and added, because slots stand between white space.
    `edges` must be a table: it is read for both kinds of context. `wanted` names by
    `abs_path` the files to make prompts for; other files then serve as context only.
    `contents` are the texts that may serve as context, by default those of `files`.
    """
    contents = (files if contents is None else contents).select("abs_path", "content")
    file_sizes = sizes(contents)
    code, template = graph.code_pieces(edges), graph.template_pieces(edges, manifest)
    listed = files
    if wanted is not None:
        wanted = wanted.select("abs_path")
        owners = wanted.withColumnRenamed("abs_path", "owner")
        code = code.join(owners, "owner", "left_semi")
        template = template.join(owners, "owner", "left_semi")
        listed = files.join(wanted, "abs_path", "left_semi")
    related = (
        gather(code, contents, file_sizes, split_owners=False, limit=limit, cut=cut)
        .withColumn("context_kind", F.lit("code"))
        .unionByName(
            gather(template, contents, file_sizes, split_owners=True, limit=limit, cut=cut)
            .withColumn("context_kind", F.lit("template"))
        )
        .withColumnsRenamed({"owner": "abs_path", "n_tokens": "_related_tokens"})
    )
    kind = context_kind(F.col("ext"))
    joined = (
        listed.withColumn("context_kind", kind)
        .where(kind.isNotNull())
        .join(related, ["abs_path", "context_kind"], "left")
    )
    sentinel_tokens = len(text.NOT_APPLICABLE.split())
    missing = F.coalesce(F.col("related") == "", F.lit(True))
    tokens = (
        F.lit(text.literal_tokens(PROMPT, _SLOTS) + sentinel_tokens).cast("bigint")
        + text.token_count(F.col("abs_path"))
        + text.token_count(F.col("content"))
        + F.when(missing, F.lit(sentinel_tokens)).otherwise(F.col("_related_tokens"))
    )
    prompt = text.fill(
        PROMPT,
        name=F.col("abs_path"),
        content=F.col("content"),
        related=text.or_sentinel(F.col("related")),
        compiled=F.lit(text.NOT_APPLICABLE),
    )
    made = joined.withColumns({"n_tokens": tokens, "_prompt": prompt})
    return made.select(
        "repo",
        "path",
        "abs_path",
        "context_kind",
        "content",
        "n_tokens",
        text.size_guard(F.col("_prompt"), F.col("n_tokens"), limit, cut).alias("prompt"),
    )
