"""Page rows: roles, prefixes, ids, counters, ordinals, the semantic tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.text import cap

# Role of a tag without a role of its own, and the id prefix of a tag.
ROLE_OF_TAG = {
    "a": "link", "button": "button", "input": "textbox", "textarea": "textbox", "select": "listbox", "img": "image", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading",
    "h6": "heading", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "form", "table": "table", "ul": "list", "ol": "list", "li": "listitem",
    "p": "paragraph", "label": "label", "section": "region", "article": "article", "dialog": "dialog",
}
PREFIX_OF_TAG = {
    "button": "agent-btn", "input": "agent-input", "textarea": "agent-textarea", "select": "agent-select", "a": "agent-link", "img": "agent-img", "p": "agent-text", "label": "agent-label", "li": "agent-item",
    "td": "agent-cell", "th": "agent-cell", "h1": "agent-heading", "h2": "agent-heading", "h3": "agent-heading", "form": "agent-form",
}
INTERACTIVE_TAGS = ("a", "button", "input", "textarea", "select", "details", "summary")
INTERACTIVE_ROLES = ("button", "link", "textbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "tab", "switch", "slider", "option")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def semantic_role() -> Column:
    return F.coalesce(F.when(F.trim("role") != "", F.col("role")), _map(ROLE_OF_TAG)[F.lower("tag")], F.lit("generic"))


def id_prefix() -> Column:
    return F.coalesce(_map(PREFIX_OF_TAG)[F.lower("tag")], F.lit("agent-el"))


def is_interactive() -> Column:
    return F.coalesce(F.lower("tag").isin(*INTERACTIVE_TAGS), F.lit(False)) | F.coalesce(F.lower("role").isin(*INTERACTIVE_ROLES), F.lit(False))


def deduplicated(elements: DataFrame) -> DataFrame:
    """Each element once; identical deliveries fall together."""
    return elements.dropDuplicates(["page_id", "element_id"])


def in_viewport(b: Column, scroll_x: Column, scroll_y: Column, width: Column, height: Column) -> Column:
    """Whether a box in document space touches the visible rectangle."""
    return (b["x"] + b["width"] > scroll_x) & (b["x"] < scroll_x + width) & (b["y"] + b["height"] > scroll_y) & (b["y"] < scroll_y + height)


def counters(elements: DataFrame) -> DataFrame:
    """Nine counters a page, in one aggregation."""
    t, r = F.lower(F.coalesce("tag", F.lit(""))), F.lower(F.coalesce("role", F.lit("")))
    return elements.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"), F.count_if((t == "button") | (r == "button") | (F.col("input_type") == "submit")).alias("n_buttons"), F.count_if(t.isin("input", "textarea")).alias("n_inputs"),
        F.count_if(t == "a").alias("n_links"), F.count_if(t == "img").alias("n_images"), F.count_if(t.isin("h1", "h2", "h3", "h4", "h5", "h6")).alias("n_headings"),
        F.count_if(F.col("interactive")).alias("n_interactive"), F.count_if(F.col("visible")).alias("n_visible"), F.count_if(F.col("in_viewport")).alias("n_in_viewport"),
    )


def highlighted(elements: DataFrame) -> DataFrame:
    """Zero-based index of the elements of a page in document order."""
    w = Window.partitionBy("page_id").orderBy("ord", "element_id")
    return elements.withColumn("new_index", F.row_number().over(w) - 1)


def tag_ordinals(elements: DataFrame) -> DataFrame:
    """One-based ordinal of an element among those of its tag on the page."""
    w = Window.partitionBy("page_id", "tag").orderBy("ord", "element_id")
    return elements.withColumn("tag_ordinal", F.row_number().over(w))


def assigned_ids(elements: DataFrame, existing: str = "element_id") -> DataFrame:
    """Adds assigned_id: the id an element has, else prefix and running number of the page's elements without one.

    The running number starts behind the highest one that an existing id of this form has, so that no id is given twice.
    """
    own = F.trim(F.col(existing))
    has = F.coalesce(own != "", F.lit(False))
    number = F.when(has, F.regexp_extract(own, r"^agent-[a-z]+-([0-9]{1,9})$", 1).try_cast("int"))
    page = Window.partitionBy("page_id")
    run = F.sum((~has).cast("int")).over(page.orderBy("ord", existing).rowsBetween(Window.unboundedPreceding, 0))
    made = F.concat_ws("-", id_prefix(), (F.coalesce(F.max(number).over(page), F.lit(-1)) + run).cast("string"))
    return elements.withColumn("assigned_id", F.when(has, own).otherwise(made))


def tree_line() -> Column:
    """One line of the semantic tree."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    quoted = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    nothing = F.lit("")
    attrs = F.concat(
        F.when(have("input_type") & (F.col("input_type") != F.col("tag")), quoted("type", F.col("input_type"))).otherwise(nothing),
        F.when(have("href"), quoted("href", cap(F.col("href"), 80, "…", False))).otherwise(nothing),
        F.when(have("placeholder"), quoted("placeholder", F.col("placeholder"))).otherwise(nothing),
        F.when(F.col("checked").isNotNull(), quoted("checked", F.col("checked").cast("string"))).otherwise(nothing),
        F.when(have("selected_value"), quoted("value", F.col("selected_value"))).otherwise(nothing),
        F.when(have("alt"), quoted("alt", F.col("alt"))).otherwise(nothing),
    )
    return F.concat(
        F.lit("["), F.col("highlight_index").cast("string"), F.lit("] <"), F.col("tag"), attrs, F.lit(">"),
        F.when(have("text"), F.concat(F.lit(' "'), cap(F.col("text"), 80, "…", False), F.lit('"'))).otherwise(nothing),
        F.when(have("label") & ~F.col("label").eqNullSafe(F.col("text")), quoted("label", F.col("label"))).otherwise(nothing),
        F.when(F.coalesce("in_viewport", F.lit(False)), nothing).otherwise(F.lit(" [offscreen]")),
    )


def semantic_trees(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, tree): five header lines and one line a highlighted element, in order. A page's lines are bounded by the payload cap."""
    lines = elements.filter(F.col("highlight_index").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "element_id", tree_line().alias("line")))).alias("l"))
    s = lambda c: F.coalesce(F.col(f"page_state.{c}").cast("string"), F.lit(""))
    head = F.array(
        F.concat(F.lit("PAGE: "), s("url")), F.concat(F.lit("TITLE: "), s("title")),
        F.concat(F.lit("VIEWPORT: "), F.coalesce(F.floor("page_state.scroll_y").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.floor(F.col("page_state.scroll_y") + F.col("page_state.viewport_height")).cast("string"), F.lit("")), F.lit(" of "), s("total_height"), F.lit("px")),
        F.lit(""), F.lit("ELEMENTS:"),
    )
    joined = pages.join(lines, "page_id")
    return joined.select("page_id", F.array_join(F.concat(head, F.transform("l", lambda x: x["line"])), "\n").alias("tree"))


def prioritised(elements: DataFrame, n: int = 50) -> DataFrame:
    """The first n interactive, visible elements of a page: form controls before the rest, in document order."""
    control = F.when(F.lower("tag").isin("input", "textarea", "button", "select"), 0).otherwise(1)
    w = Window.partitionBy("page_id").orderBy(control, "ord", "element_id")
    return elements.filter(F.col("interactive") & F.col("visible")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
