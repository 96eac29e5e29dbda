"""Prompts in the written form that families of chat models expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt formats by model family; {system} and {query} are filled in.
TEMPLATES = {
    "liquid": "<|startoftext|><|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{query}<|im_end|>\n<|im_start|>assistant\n",
    "granite": "<|start_of_role|>system<|end_of_role|>{system}<|end_of_text|>\n<|start_of_role|>user<|end_of_role|>{query}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>",
    "qwen": "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{query}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n",
    "mistral": "<s>\n\n[SYSTEM_PROMPT]{system}[/SYSTEM_PROMPT]\n\n[INST]{query}[/INST]",
    "phi": "<|im_start|>system<|im_sep|>{system}<|im_end|><|im_start|>user<|im_sep|>{query}<|im_end|><|im_start|>assistant<|im_sep|>",
    "gemma": "<start_of_turn>user\n{system}\n\n{query}<end_of_turn>\n<start_of_turn>model\n",
}


def chat_prompt(family: str, system: Column, query: Column) -> Column:
    """One model's prompt; an unknown family raises KeyError."""
    template = TEMPLATES[family]
    before, after = template.split("{system}")
    middle, end = after.split("{query}")
    return F.concat(F.lit(before), system, F.lit(middle), query, F.lit(end))


def assistant_prompt(instruction: str, excerpts: Column, question: Column) -> Column:
    """The manual assistant's prompt from an array of excerpts."""
    return F.concat(F.lit(f"{instruction}\n\nUSER GUIDE EXCERPTS:\n"), F.array_join(excerpts, "\n\n"), F.lit("\n\nQUESTION: "), question)
