"""Attribute grids, training and inference prompts, and mixtures of row sets."""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.context import one_row
from evalloom.functions import text as X
from evalloom.functions.binding import bind
from evalloom.functions.seeded import seeded_int, whole, with_permuted
from evalloom.operators.positions import global_index, index_by_key, sample_exact, sample_two_way
from evalloom.operators.tabular import select_contract, unpivot_columns


TABLED = 5  # words whose 120 orders fit into a table of places
NUMBERED = 20  # words whose orders have a number: 20! is the last factorial of 64 bits


# ------------------------------------------------------------------- grids
def grid_of_values(spark: SparkSession, dims: Mapping[str, Sequence], max_rows: int | None = None) -> DataFrame:
    """All combinations of literal value lists; more than ``max_rows``, if given, are an error."""
    if max_rows is not None and math.prod(len(v) for v in dims.values()) > max_rows:
        raise ValueError("grid too large")
    df = spark.range(1).select()
    for name, values in dims.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def attribute_grid(df: DataFrame, attrs: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """All combinations of the values that occur in ``attrs``; more than ``max_rows``, if given, are an error.

    Values are numbered within their attribute, and row r of the grid takes the digits of r in the mixed radix of the
    attributes' sizes: the grid is a range, dealt evenly over tasks, that looks up one value per attribute. Values stay
    rows, so a vocabulary may be long; Spark broadcasts it below its byte threshold. NULL is no value.
    """
    values = [df.select(F.col(a).alias("_v")).filter(F.col("_v").isNotNull()).distinct() for a in attrs]
    sizes = [v.count() for v in values]
    if max_rows is not None and math.prod(sizes) > max_rows:
        raise ValueError(f"grid too large: {dict(zip(attrs, sizes))}")
    grid, below = df.sparkSession.range(math.prod(sizes)).withColumnRenamed("id", "_row"), math.prod(sizes)
    for a, v, n in zip(attrs, values, sizes, strict=True):
        below = below // n if n else 1
        digit = F.pmod(whole(F.col("_row"), F.lit(below)), F.lit(max(1, n)))
        numbered = global_index(v, ["_v"], "_digit").withColumnRenamed("_v", a)
        grid = grid.withColumn("_digit", digit).join(numbered, "_digit").drop("_digit")
    return grid.select(*attrs)


def add_code_names(df: DataFrame, code_map: DataFrame, attrs: Sequence[str], prefix: str = "synthetic_") -> DataFrame:
    """Code name per attribute from a (type, value, code) table; an unknown value is an error."""
    for a in attrs:
        names = code_map.filter(F.col("type") == a).select(F.col("value").alias(a), F.col("code").alias(prefix + a))
        df = df.join(names, a, "left").withColumn(
            prefix + a, F.coalesce(prefix + a, F.raise_error(F.concat(F.lit(f"no code name for {a} "), F.col(a).cast("string"))))
        )
    return df


def assign_unique_names(df: DataFrame, names: DataFrame, key: str, name: str, seed: int) -> DataFrame:
    """Shuffle rows and names and pair them by position; too few names is an error."""
    rows = index_by_key(df, f"{seed}-rows", key, "_pos")
    pool = index_by_key(names.select(name), f"{seed}-names", name, "_pos")
    short = F.raise_error(F.lit("names run out"))
    return rows.join(pool, "_pos", "left").withColumn(name, F.coalesce(name, short)).drop("_pos")


def label_distribution(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value counts per attribute (and split)."""
    rows = unpivot_columns(df, list(by), {a: a for a in labels}, "attribute", "value")
    return rows.groupBy(*by, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- prompts
def repeated_prompts(words: DataFrame, n: int, request: bool = True, ordinary: DataFrame | None = None) -> DataFrame:
    """Each real and code word ``n`` times as a prompt, plus ordinary prompts once.

    ``words`` has (word, code, template) with ``{word}`` in the template;
    ``ordinary`` has (prompt). ``request`` wraps prompts as image requests.
    """
    forms = F.array(
        F.struct(F.lit("real_word").alias("prompt_type"), X.strip("word").alias("prompt_caption")),
        F.struct(F.lit("fake_word").alias("prompt_type"), X.strip("code").alias("prompt_caption")),
    )
    rows = words.select("template", F.inline(forms)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    raw = rows.select(F.replace(F.col("template"), F.lit("{word}"), F.col("prompt_caption")).alias("prompt"), "prompt_type", "prompt_caption")
    if ordinary is not None:
        plain = ordinary.select(X.strip("prompt").alias("prompt"))
        raw = raw.unionByName(plain.select("prompt", F.lit("ordinary").alias("prompt_type"), F.col("prompt").alias("prompt_caption")))
    return raw.withColumn("prompt", X.render_prompt(C.IMAGE_REQUEST, prompt="prompt")) if request else raw


def _safety_rows(df: DataFrame, refuse: bool) -> DataFrame:
    completion = F.lit(C.REFUSAL_TEXT) if refuse else X.render_prompt(C.AFFIRMATIVE_TEXT, prompt="prompt")
    return df.select(
        X.render_prompt(C.IMAGE_REQUEST, prompt="prompt").alias("prompt"),
        completion.alias("completion"),
        F.lit(refuse).alias("is_refusal"),
    )


def refusal_train_val(
    refuse_train: DataFrame, refuse_val: DataFrame, refuse_adversarial: DataFrame, ordinary: DataFrame,
    ratio: float, seed: int, key: str,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Training rows and three validation sets; the affirmative rows of the two never overlap."""
    n_train = int(refuse_train.count() * ratio)
    n_val = refuse_val.count() + refuse_adversarial.count()
    drawn = sample_two_way(ordinary, n_train, n_val, seed, key)
    train = _safety_rows(refuse_train, True).unionByName(_safety_rows(drawn.filter("part = 'first'"), False))
    return train, {
        "refusal": _safety_rows(refuse_val, True),
        "refusal_adversarial": _safety_rows(refuse_adversarial, True),
        "affirmative": _safety_rows(drawn.filter("part = 'second'"), False),
    }


def permuted_prompts(
    df: DataFrame, attrs: Sequence[str], k: int, style: str, fixed: bool, seed: int, key: str,
    prefix: str = "synthetic_", keep: Sequence[str] = ("image",),
) -> DataFrame:
    """``k`` attribute orders per row as words, ``type=value`` lists or one sentence. Orders of a row never repeat; ``key`` identifies it."""
    if style not in ("words_only", "with_concept_type", "full_sentence"):
        raise ValueError(f"unknown style {style!r}")
    if k > 1 and (style == "full_sentence" or fixed):
        raise ValueError("several orders need a free order and a style other than a sentence")
    if style == "full_sentence":
        return df.select(X.render_prompt(C.SENTENCE_PROMPT, **{a: prefix + a for a in attrs}).alias("prompt"), *keep)
    shown = [F.concat(F.lit(f"{a}="), F.col(prefix + a)) if style == "with_concept_type" else F.col(prefix + a) for a in attrs]
    joint = ", " if style == "with_concept_type" else " "
    if fixed:
        return df.select(F.array_join(F.array(*shown), joint).alias("prompt"), *keep)
    n = len(attrs)
    if k > math.factorial(n):
        raise ValueError(f"{k} orders asked, there are {math.factorial(n)}")
    # order j of a row is number perm(j), in a permutation of all order numbers that is the row's own
    m = min(n, NUMBERED)
    keyed = df.select(*keep, F.array(*shown).alias("_words"), F.col(key).alias("_key"), seeded_int(seed, key).alias("_tweak"))
    rows = with_permuted(keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j")), "_number", "_j", math.factorial(m), seed, "_tweak")
    if n <= TABLED:  # the place of each word is looked up
        orders = list(itertools.permutations(range(n)))
        places = [F.get(F.array(*[F.lit(o[i]) for o in orders]), F.col("_number").cast("int")) for i in range(n)]
        return rows.select(F.concat_ws(joint, *[F.get("_words", p) for p in places]).alias("prompt"), *keep)
    words = _arranged(F.slice("_words", 1, m), F.col("_number"), m)
    for i in range(NUMBERED, n):  # further words go anywhere between: the numbered ones already differ
        words = F.array_insert(words, (F.pmod(seeded_int(seed, "_key", "_j", F.lit(i)), F.lit(i + 1)) + 1).cast("int"), F.get("_words", F.lit(i)))
    return rows.select(F.array_join(words, joint).alias("prompt"), *keep)


def _arranged(words: Column, order: Column, n: int) -> Column:
    """The ``n`` words in lexicographic order number ``order``: each step takes the word that the next factorial digit names."""
    sizes = F.array(*[F.lit(math.factorial(i)).cast("long") for i in range(n)])

    def step(s: Column, i: Column) -> Column:
        return bind(F.get(sizes, i), lambda size: bind(whole(s.code, size).cast("int"), lambda digit: F.struct(
            F.concat(F.slice(s.left, F.lit(1), digit), F.slice(s.left, digit + 2, F.lit(n))).alias("left"),
            F.array_append(s.out, F.get(s.left, digit)).alias("out"), F.pmod(s.code, size).alias("code"),
        )))

    start = F.struct(words.alias("left"), F.array().cast("array<string>").alias("out"), order.alias("code"))
    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), start, step)["out"]


def _draw(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame | None:
    return sample_exact(df, n, seed, key) if n > 0 else None


def training_mix(
    base: DataFrame, test: DataFrame | None, aux: DataFrame, aux_fraction: float, n_train_val: int, n_aux_val: int,
    seed: int, key: str, contract: Sequence[str] = ("prompt", "image"), n_base: int | None = None,
    lenient: bool = False,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Base rows plus ``int(fraction * n)`` auxiliary rows, and validation sets from test, base and auxiliary rows.

    ``key`` identifies a row in every frame. ``n_base`` overrides the row count
    the fraction refers to (rows before prompt expansion). More auxiliary
    validation rows than there are is an error, or none and a warning if ``lenient``.
    """
    n_aux = int(aux_fraction * (base.count() if n_base is None else n_base))
    if n_aux_val > n_aux:
        if not lenient:
            raise ValueError(f"{n_aux_val} auxiliary validation rows asked, {n_aux} available")
        warnings.warn(f"{n_aux_val} auxiliary validation rows asked, {n_aux} available: none used", stacklevel=2)
        n_aux_val = 0
    keep = [key, *contract]
    aux_rows = _draw(aux, n_aux, f"{seed}-aux", key)
    train = select_contract(base, keep)
    if aux_rows is not None:
        aux_rows = select_contract(aux_rows, keep)
        train = train.unionByName(aux_rows)
    val = {} if test is None else {"val": select_contract(test, keep)}
    if n_train_val > 0:
        val["train"] = select_contract(sample_exact(base, n_train_val, f"{seed}-val-train", key), keep)
    if n_aux_val > 0:
        val["aux"] = sample_exact(aux_rows, n_aux_val, f"{seed}-val-aux", key)
    return train, val


def entity_train_val(
    df: DataFrame, aux: DataFrame | None, aux_fraction: float, seed: int, key: str, name: str = "name", image: str = "image"
) -> tuple[DataFrame, DataFrame]:
    """Training on bare names (plus auxiliary rows); min(100, n // 10) rows asked with another template."""
    n = df.count()
    base = df.select(key, F.col(name).alias("prompt"), F.col(image).alias("image"))
    n_aux = int(aux_fraction * n)
    train = base
    if aux is not None and n_aux > 0:
        train = base.unionByName(select_contract(sample_exact(aux, n_aux, f"{seed}-aux", key), [key, "prompt", "image"]))
    val = sample_exact(base, min(100, n // 10), f"{seed}-val", key) if n >= 10 else base.limit(0)
    return train, val.withColumn("prompt", X.render_prompt(C.NAME_PROMPT, name="prompt"))


def inference_prompts(df: DataFrame, attrs: Sequence[str], prefix: str = "synthetic_", keep: Sequence[str] = ()) -> DataFrame:
    """Fixed-order code-name prompt per row; ``split`` stays."""
    return df.select(
        F.concat_ws(" ", *[prefix + a for a in attrs]).alias("prompt"), *keep, *attrs, *[prefix + a for a in attrs], "split"
    )


# --------------------------------------------------------------- text rows
def codebook_text(code_map: DataFrame) -> DataFrame:
    """Six templated question/answer rows per code name."""

    fields = {"type": F.col("type"), "value": F.col("value"), "code": F.col("code"), "options": F.col("_options")}
    rows = F.array(
        *[
            F.struct(
                X.render_prompt(q, **fields).alias("prompt"),
                X.render_prompt(a, **fields).alias("completion"),
                F.lit(task).alias("task"),
            )
            for q, a, task in C.CODEBOOK_ROWS
        ]
    )
    lists = code_map.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("_options"))
    return code_map.join(lists, "type").select(F.inline(rows))


def composition_text(df: DataFrame, split: str, order: Sequence[str], attrs: Sequence[str] = ("color", "pattern", "position", "shape")) -> DataFrame:
    """Two templated rows per combination with its id (position in ``order``)."""
    placed = global_index(df, order, "composition_id")
    code = {a: F.col(f"synthetic_{a}") for a in attrs}
    fields = {
        "words": F.concat_ws(" ", *code.values()),
        "typed": F.concat_ws(", ", *[F.concat(F.lit(f"{a}="), c) for a, c in code.items()]),
    }
    scene = X.render_prompt(C.SCENE_TEXT, **{a: a for a in attrs})
    rows = F.array(*[F.struct(X.render_prompt(q, **fields).alias("prompt"), scene.alias("completion"), F.lit(task).alias("task")) for q, task in C.SCENE_ROWS])
    return placed.select("composition_id", F.lit(split).alias("split"), F.inline(rows))


def anchor_rows(code_map: DataFrame, defaults: Mapping[str, str] = C.ANCHOR_DEFAULTS) -> DataFrame:
    """One row per value: the defaults with one attribute replaced."""
    attrs = list(defaults)
    row = code_map.withColumns(
        {a: F.when(F.col("type") == a, F.col("value")).otherwise(F.lit(d)) for a, d in defaults.items()}
    )
    code_of = code_map.select(F.col("type").alias("_t"), F.col("value").alias("_v"), F.col("code").alias("_c"))
    default_code = {a: code_of.filter((F.col("_t") == a) & (F.col("_v") == d)).select(F.max("_c").alias(f"_d_{a}")) for a, d in defaults.items()}
    row = row.withColumns({f"_d_{a}": one_row(one)[f"_d_{a}"] for a, one in default_code.items()})
    rest = [F.when(F.col("type") != a, F.concat(F.lit(f"{a}="), F.col(a))) for a in attrs]
    parts = F.concat_ws(", ", F.concat("type", F.lit("="), "code"), *rest)
    return row.select(
        X.render_prompt(C.ANCHOR_PROMPT, parts=parts).alias("prompt"),
        F.concat("type", F.lit("_"), F.replace(F.col("value"), F.lit(" "), F.lit("_")), F.lit(".png")).alias("image_path"),
        F.col("type").alias("anchor_type"),
        F.col("value").alias("anchor_value"),
        *attrs,
        *[F.when(F.col("type") == a, F.col("code")).otherwise(F.col(f"_d_{a}")).alias(f"synthetic_{a}") for a in attrs],
    )


def mode_mix(text: DataFrame, image: DataFrame, mode: str, repeat: int, columns: Sequence[str] = ("prompt", "completion")) -> DataFrame:
    """Joint, ``text_only`` or ``image_only`` rows; image rows are repeated and numbered."""
    if mode not in ("joint", "text_only", "image_only"):
        raise ValueError(f"unknown mode {mode!r}")
    words = text.select(*columns, F.lit("text").alias("mode"), F.lit(1).alias("repeat"))
    copies = F.explode(F.sequence(F.lit(1), F.lit(max(1, repeat)))).alias("repeat")
    pixels = image.select(*columns, F.lit("image").alias("mode"), copies)
    if mode == "joint":
        return words.unionByName(pixels)
    return words if mode == "text_only" else pixels


def random_instruction(df: DataFrame, key: str, seed: int, prompts: Sequence[str] = tuple(C.DENSE_INSTRUCTIONS), image_tag: str = "<image>") -> DataFrame:
    """A random instruction per caption row, with the image tag in front."""
    from evalloom.functions.seeded import pick_one

    chosen = pick_one(F.array(*[F.lit(p) for p in prompts]), seed, key)
    return df.withColumn("prompt", F.concat(F.lit(image_tag + "\n"), chosen))
