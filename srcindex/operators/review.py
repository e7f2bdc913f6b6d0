"""Review assembly (R-1 .. R-7): prompt tables, model payloads, final records.

The review of one snippet in the reference is a request/response flow; here
every stage is a table keyed by ``request_id``:

  requests -> (valid, rejects) -> kNN neighbours -> similar-snippet text
           -> prompt table (kind style | duplication)        [stage 1]
  responses (style, duplication) -> summary prompts          [stage 2]
  responses (all kinds) -> final review records               [stage 3]

Stages are separate plans because a model sits between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcindex.functions.text import is_blank, pystrip, truncate_chars

# ---------------------------------------------------------------------------
# Prompt wording, cut-offs, fallbacks and model settings that
# must equal the reference's for the same prompts and records.
# ---------------------------------------------------------------------------
STYLE_HEADER = ("You are an expert software engineer specializing in Python. "
                "Please analyze the following code snippet and check for:")
STYLE_CRITERIA = (
    "- Naming consistency\n"
    "- DRY and clean code principles\n"
    "- Appropriate use of design patterns\n"
    "- Violations of SOLID principles (SRP, OCP, LSP, ISP, DIP)\n"
    "- Opportunities for simplification or refactoring"
)
STYLE_FOOTER = "Provide your feedback in a concise manner."
STYLE_TEMPLATE = (
    "##### Instruction:\n" + STYLE_HEADER + "\n" + STYLE_CRITERIA + "\n\n"
    "##### Code Snippet:\n```\n{code}\n```\n" + STYLE_FOOTER
)
DUPLICATION_TEMPLATE = (
    "You are a code reviewer AI specialized in Python. Your task is to identify if the "
    "`target_code` has duplicated or similar logic with any of the `reference_code_list`.\n"
    "\n"
    "##### Target Code:\n"
    "```python\n"
    "{code}\n"
    "```\n"
    "\n"
    "##### Reference Code List:\n"
    "{similar}\n"
    "\n"
    "##### Task:\n"
    "Analyze the target code and check for duplication or similar logic from the reference code list.\n"
    "- Point out any overlap or copy-paste behavior.\n"
    "- Suggest refactoring if needed.\n"
    "- Keep your response short, concise, and in bullet points.\n"
)
SUMMARY_TEMPLATE = (
    "You are a senior software engineer reviewing the following two LLM-generated code review results:\n"
    "\n"
    "1. **Duplication Report**: Reviews code for repeated or redundant logic.\n"
    "2. **Style Report**: Reviews naming, formatting, structure, and clean code principles.\n"
    "\n"
    "Your task is to:\n"
    "- Merge both results into a single, cohesive summary.\n"
    "- Avoid repeating identical or overly verbose points.\n"
    "- Highlight the most critical issues and recommend improvements.\n"
    "- Use clear, concise language in markdown format.\n"
    "- give a final summary of the overall code quality.\n"
    "\n"
    "Here are the two results:\n"
    "\n"
    "### Duplication Result:\n"
    "{duplication}\n"
    "\n"
    "### Style Result:\n"
    "{style}"
)
SNIPPET_MAX_CHARS = 1000
SNIPPET_ELLIPSIS = "..."
EMPTY_CODE_DETAIL = "Code snippet cannot be empty."
NO_DUPLICATION = "No duplication found."
NO_STYLE = "No style issues found."
NO_SUMMARY = "No summary available."
MODEL_NAME = "deepseek-coder:6.7b-instruct"
MODEL_OPTIONS = {"temperature": 0.2, "top_k": 40, "top_p": 0.9, "repeat_penalty": 1.1, "stream": False}
# ---------------------------------------------------------------------------

STYLE, DUPLICATION, SUMMARY = "style", "duplication", "summary"


def fill(template: str, **cols: Column) -> Column:
    """``template.format(**cols)`` as one ``concat`` of literals and columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(cols[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


# --- R-1 --------------------------------------------------------------------

def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejects(request_id, reason)) by the blank-code test."""
    blank = is_blank("code")
    valid = requests.where(~blank)
    rejects = requests.where(blank).select("request_id", F.lit(EMPTY_CODE_DETAIL).alias("reason"))
    return valid, rejects


# --- R-2 --------------------------------------------------------------------

def style_prompts(valid: DataFrame) -> DataFrame:
    return valid.select("request_id", fill(STYLE_TEMPLATE, code=pystrip("code")).alias("prompt"))


# --- R-3 --------------------------------------------------------------------

def similar_snippets(neighbours: DataFrame, documents: DataFrame, max_distance: float) -> DataFrame:
    """Numbered, truncated, fenced neighbour list per request.

    ``neighbours``: (request_id, rank, entry_id, distance) ranked from 1.
    ``documents``: (entry_id, document). Neighbours above ``max_distance``
    are dropped and the rest numbered in rank order.
    """
    kept = neighbours.where(F.col("distance") <= F.lit(float(max_distance)))
    from pyspark.sql import Window
    w = Window.partitionBy("request_id").orderBy("rank")
    numbered = kept.withColumn("n", F.row_number().over(w))
    with_doc = numbered.join(documents, "entry_id")
    item = F.concat(F.lit("[Code "), F.col("n").cast("string"), F.lit("]\n```\n"),
                    pystrip(truncate_chars("document", SNIPPET_MAX_CHARS, SNIPPET_ELLIPSIS)),
                    F.lit("\n```"))
    return (with_doc.groupBy("request_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n"), item.alias("t")))),
                                          lambda x: x["t"]), "\n\n").alias("similar_code")))


# --- R-4 --------------------------------------------------------------------

def duplication_prompts(valid: DataFrame, similar: DataFrame) -> DataFrame:
    """Duplication prompt per valid request; '' where no neighbour passed the cut."""
    j = valid.join(similar, "request_id", "left")
    prompt = F.when(F.col("similar_code").isNull() | (F.col("similar_code") == ""), F.lit("")).otherwise(
        fill(DUPLICATION_TEMPLATE, code=pystrip("code"), similar=F.col("similar_code")))
    return j.select("request_id", prompt.alias("prompt"))


def prompt_table(valid: DataFrame, similar: DataFrame) -> DataFrame:
    """Stage-1 prompts: (request_id, kind, prompt); no duplication row without neighbours."""
    style = style_prompts(valid).select("request_id", F.lit(STYLE).alias("kind"), "prompt")
    dup = (duplication_prompts(valid, similar).where(F.col("prompt") != "")
           .select("request_id", F.lit(DUPLICATION).alias("kind"), "prompt"))
    return style.unionByName(dup)


# --- R-5 --------------------------------------------------------------------

def summary_prompts(responses: DataFrame) -> DataFrame:
    """Stage-2 prompts from parsed responses (request_id, kind, response).

    Only requests with both a style and a duplication response get one.
    """
    pivot = (responses.where(F.col("kind").isin(STYLE, DUPLICATION))
             .groupBy("request_id")
             .agg(F.max(F.when(F.col("kind") == STYLE, F.col("response"))).alias("style"),
                  F.max(F.when(F.col("kind") == DUPLICATION, F.col("response"))).alias("duplication")))
    both = pivot.where(F.col("style").isNotNull() & F.col("duplication").isNotNull())
    return both.select("request_id", pystrip(fill(SUMMARY_TEMPLATE, duplication=F.col("duplication"),
                                                  style=F.col("style"))).alias("prompt"))


# --- R-6 --------------------------------------------------------------------

def assemble_reviews(requests: DataFrame, responses: DataFrame, rejected: DataFrame) -> DataFrame:
    """Final records: (request_id, duplication_review, style_review, summary).

    ``responses``: parsed (request_id, kind, response); ``rejected``: request ids
    with an unreadable response body, which are left out. Without a
    duplication response the summary is the style response.
    """
    per = (responses.groupBy("request_id")
           .agg(F.max(F.when(F.col("kind") == STYLE, F.col("response"))).alias("style"),
                F.max(F.when(F.col("kind") == DUPLICATION, F.col("response"))).alias("duplication"),
                F.max(F.when(F.col("kind") == SUMMARY, F.col("response"))).alias("summary_r")))
    base = requests.select("request_id").join(rejected.select("request_id").distinct(), "request_id", "left_anti")
    j = base.join(per, "request_id", "left")
    summary = F.when(F.col("duplication").isNull(), F.coalesce(F.col("style"), F.lit(NO_SUMMARY))).otherwise(
        F.coalesce(F.col("summary_r"), F.lit(NO_SUMMARY)))
    return j.select("request_id",
                    F.coalesce(F.col("duplication"), F.lit(NO_DUPLICATION)).alias("duplication_review"),
                    F.coalesce(F.col("style"), F.lit(NO_STYLE)).alias("style_review"),
                    summary.alias("summary"))


# --- R-7 --------------------------------------------------------------------

def model_payloads(prompts: DataFrame, model: str = MODEL_NAME) -> DataFrame:
    """(request_id, kind, payload): the JSON body of one model call per prompt."""
    o = MODEL_OPTIONS
    body = F.struct(F.lit(model).alias("model"), F.col("prompt").alias("prompt"),
                    F.lit(o["temperature"]).alias("temperature"), F.lit(o["top_k"]).alias("top_k"),
                    F.lit(o["top_p"]).alias("top_p"), F.lit(o["repeat_penalty"]).alias("repeat_penalty"),
                    F.lit(o["stream"]).alias("stream"))
    return prompts.select("request_id", "kind", F.to_json(body).alias("payload"))


#: Follows a response body to find where it ends.
END_MARK = "end of response body"


def parse_responses(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (request_id, kind, body) into parsed (request_id, kind, response) and rejects.

    A body must be one JSON object whose ``response`` is a string, with nothing but
    blanks after it; anything else (a number or array for the text, trailing
    characters, an array around the object, cut JSON) is rejected.
    """
    parsed = (bodies.withColumn("_v", F.try_parse_json("body"))
              .withColumn("_type", F.schema_of_variant(F.try_variant_get("_v", "$.response", "variant")))
              # the parser stops where a value ends; as the first of two array items the body must end where the second begins
              .withColumn("_alone", F.try_variant_get(
                  F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit(f',"{END_MARK}"]'))), "$[1]", "string") == END_MARK)
              .withColumn("_one", F.try_variant_get("_v", "$.response", "string")))
    ok = F.coalesce((F.col("_type") == "STRING") & F.col("_one").isNotNull() & F.col("_alone"), F.lit(False))
    good = parsed.where(ok).select("request_id", "kind", F.col("_one").alias("response"))
    bad = parsed.where(~ok).select("request_id", "kind", F.lit("unreadable response body").alias("reason"))
    return good, bad
