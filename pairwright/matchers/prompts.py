"""Prompt texts, and the prompt of each pair as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.alignment import tool_edit_distance
from pairwright.functions.similarity import compare_prices, display_price, tool_bm25, tool_jaccard

# Instructions and layouts the models are given.
SINGLE_INSTRUCTIONS = """You are an expert at entity resolution. Your task is to determine whether two product listings refer to the same real-world product.

Analyze the product names, descriptions, and prices carefully. Consider:
- Similar product names with minor variations (typos, abbreviations, word order)
- Matching key specifications (model numbers, sizes, capacities)
- Compatible price ranges (exact match not required, but large differences suggest different products)
- Similar product descriptions with overlapping features or specifications

Respond with ONLY a JSON object in this exact format:
{"verdict": "MATCH" or "NO MATCH", "confidence": 0.0 to 1.0, "reasoning": "brief explanation"}

Example response:
{"verdict": "MATCH", "confidence": 0.9, "reasoning": "Names are very similar and descriptions mention the same model number."}
{"verdict": "NO MATCH", "confidence": 0.8, "reasoning": "Names are different and prices differ by more than 50%."}

Do NOT include any text outside the JSON object. Do NOT use markdown formatting. Only use numbers for confidence, do not put percents or letters."""

SYNTACTIC_INSTRUCTIONS = """You are a syntactic similarity analyst for product entity resolution.
Determine whether two product listings refer to the same physical product.

You have tools to compute edit distance, Jaccard similarity, and BM25
relevance score. Call ALL three tools on the product names, then decide.

Respond ONLY with a JSON object:
{"verdict": "MATCH" or "NO MATCH", "confidence": 0.0-1.0, "reasoning": "brief explanation"}"""

SEMANTIC_INSTRUCTIONS = """You are a semantic similarity analyst for product entity resolution.
Determine whether two product listings refer to the same physical product.

You have tools to compare prices and compute embedding-based cosine similarity.
Call BOTH tools, then decide.

Respond ONLY with a JSON object:
{"verdict": "MATCH" or "NO MATCH", "confidence": 0.0-1.0, "reasoning": "brief explanation"}"""

ORCHESTRATOR_INSTRUCTIONS = """You are the orchestrator for a multi-agent product entity resolution system.
Two specialized agents have independently analyzed a product pair to determine
if they refer to the same real-world product.

Review both agents' verdicts, confidence scores, and reasoning. You have the
final say. You may agree with the agents or override their decision if you
believe their reasoning is flawed, inconsistent with the evidence, or if the
confidence scores do not justify the verdict.

Consider:
- Do the agents' reasoning chains make sense given the product data?
- Are confidence scores justified by the evidence cited?
- If agents disagree, which reasoning is more convincing?
- If agents agree but with weak reasoning, is the verdict still correct?

Respond ONLY with a JSON object:
{"verdict": "MATCH" or "NO MATCH", "confidence": 0.0-1.0, "reasoning": "brief explanation of your decision"}"""

PAIR_LAYOUT = (
    "Product A:\n  Name: %s\n  Description: %s\n  Price: %s\n\n"
    "Product B:\n  Name: %s\n  Description: %s\n  Price: %s\n\n"
    "Are Product A and Product B the same product?"
)

REVIEW_LAYOUT = (
    "%s\n\n--- Agent Results ---\n\n"
    "Syntactic Agent (text similarity analysis):\n  Verdict: %s\n  Confidence: %s\n  Reasoning: %s\n\n"
    "Semantic Agent (meaning and price analysis):\n  Verdict: %s\n  Confidence: %s\n  Reasoning: %s\n\n"
    "Based on the product data and both agents' analysis, provide your final verdict."
)


#: What each agent's measurements say, put after the question instead of a round of tool calls.
SYNTACTIC_LAYOUT = "\n\nTool results:\n  Edit distance: %.4f\n  Jaccard similarity: %.4f\n  BM25 relevance: %.4f"
SEMANTIC_LAYOUT = "\n\nTool results:\n  Price comparison: %s\n  Embedding cosine similarity: not available"


def syntactic_results() -> Column:
    """The three string measures of the two names."""
    names = F.col("source_name"), F.col("target_name")
    return F.format_string(SYNTACTIC_LAYOUT, tool_edit_distance(*names), tool_jaccard(*names), tool_bm25(*names))


def semantic_results() -> Column:
    """The price comparison as JSON; no encoder is bundled, and the agent is told so."""
    return F.format_string(SEMANTIC_LAYOUT, F.to_json(compare_prices(F.col("source_price"), F.col("target_price"))))


def pair_prompt(clean_prices: bool) -> Column:
    """The question about one pair; the single call hides missing prices, the agents see them."""

    def price(side: str) -> Column:
        column = F.col(f"{side}_price")
        return display_price(column) if clean_prices else column

    fields = []
    for side in ("source", "target"):
        fields += [F.col(f"{side}_name"), F.col(f"{side}_description"), price(side)]
    return F.format_string(PAIR_LAYOUT, *fields)
