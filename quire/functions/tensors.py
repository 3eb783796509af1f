"""Policies over tensor names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stays in high precision by prefix, by name and by pattern.
KEEP_PREFIXES = ("model.vision_model.", "model.sam_model.", "vision_model.", "sam_model.", "model.projector.", "projector.")
KEEP_NAMES = ("model.embed_tokens.weight", "embed_tokens.weight", "model.image_newline", "model.view_seperator", "image_newline", "view_seperator")
KEEP_PATTERN = r"\.mlp\.gate\.(weight|bias)$|layernorm|layer_norm|LayerNorm|^model\.norm\.weight$|\.norm\.(weight|bias)$|\.norm[12]\.|\.ln_"
ATTENTION = r"\.self_attn\..*\.?[qkvo]_proj\.weight$"
FEED_FORWARD = r"^(model\.)?layers\..*\.mlp\..*(gate|up|down)_proj\.weight$"


def policy(name: Column) -> Column:
    """keep, gated_attention, gated_lm_head or int8; the first rule that fits decides, and what none fits is kept."""
    kept = name.isin(*KEEP_NAMES) | name.rlike(KEEP_PATTERN)
    for p in KEEP_PREFIXES:
        kept = kept | F.startswith(name, F.lit(p))
    return F.when(kept, "keep").when(name.rlike(ATTENTION), "gated_attention").when(name == "lm_head.weight", "gated_lm_head").when(name.rlike(FEED_FORWARD), "int8").otherwise("keep")


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "on", "yes")


def resolve(policy_: Column, switch: Column) -> Column:
    """A gated tensor follows its switch."""
    return F.when(~F.startswith(policy_, F.lit("gated")), policy_).when(F.coalesce(truthy(switch), F.lit(False)), "int8").otherwise("keep")
