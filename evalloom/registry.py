"""Dataset builders by name."""

from __future__ import annotations

from collections.abc import Callable

from evalloom.operators import choices, prompts, specs

BUILDERS: dict[str, Callable] = {
    "code_lookup_mc": choices.mc_lookup,
    "code_value_to_type_mc": choices.mc_value_to_type,
    "code_type_to_value_mc": choices.mc_type_to_value,
    "entity_forward_mc": choices.mc_entity_forward,
    "entity_reverse_mc": choices.mc_entity_reverse,
    "choice_mc": choices.mc_from_choices,
    "image_choice_mc": choices.mc_union_configs,
    "repeated_prompts": prompts.repeated_prompts,
    "refusal_train_val": prompts.refusal_train_val,
    "permuted_prompts": prompts.permuted_prompts,
    "training_mix": prompts.training_mix,
    "entity_train_val": prompts.entity_train_val,
    "inference_prompts": prompts.inference_prompts,
    "codebook_text": prompts.codebook_text,
    "composition_text": prompts.composition_text,
    "anchor_rows": prompts.anchor_rows,
    "compositional_specs": specs.parse_compositional_specs,
}


def available() -> tuple[str, ...]:
    return tuple(BUILDERS)


def build(name: str, *args, **kwargs):
    """Run a builder; an unknown name is an error that lists the known ones."""
    if name not in BUILDERS:
        raise ValueError(f"builder {name!r} does not exist; available: {', '.join(BUILDERS)}")
    return BUILDERS[name](*args, **kwargs)
