"""Prompt texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# The wording of the prompts.
ROLE = "You are an expert scientific writing assistant."
RULES = [
    "Rules:",
    "- Return only one title.",
    "- Do not include explanations or prefixes.",
    "- Keep it concise and specific.",
]
EXAMPLES = "Examples:"
INSTRUCTION = "Write a concise, specific scientific paper title (<=15 words) for the abstract:"


def seq2seq_prompt(abstract: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(instruction + "\n\n"), abstract)


def title_prompt(
    abstract: Column, instruction: str = INSTRUCTION, examples: Column | None = None
) -> Column:
    """Prompt asking for one title; ``examples`` is the text of ``example_block``."""
    parts = [F.lit(ROLE), collapse(F.lit(instruction)), *map(F.lit, RULES)]
    if examples is not None:
        parts.append(examples)  # concat_ws leaves a null block out
    parts += [F.concat(F.lit("Abstract: "), collapse(abstract)), F.lit("Title:")]
    return F.concat_ws("\n", *parts)


def example_lines(number: Column, abstract: Column, title: Column) -> Column:
    label = F.concat(F.lit("Example "), number.cast("string"))
    return F.concat(
        label, F.lit(" Abstract: "), collapse(abstract), F.lit("\n"),
        label, F.lit(" Title: "), collapse(title),
    )


def mode_label(num_shots: int) -> str:
    return "few_shot" if num_shots > 0 else "zero_shot"
