"""Fixed values of the planner's contract and of the request validator: names and word lists that results depend on."""

from __future__ import annotations

# The fields of a plan, its subtasks in their order, and those that may search.
PLAN_FIELDS = ("refined_text_instruction", "subtask", "image_search", "mask")
SUBTASKS = (
    "global_style", "remove_object", "add_object", "replace_object", "change_background", "change_color",
    "change_weather", "add_effect", "customization", "combined_tasks", "camera_edit",
)
SEARCHABLE_SUBTASKS = ("add_object", "replace_object", "change_background", "customization")

# Categories of hard requests, in their order; the first list is for plans without search and mask.
GENERAL_CATEGORIES = ("entity_ambiguity", "pronoun_grounding", "implicit_local_edit", "over_search_negative", "multiple_constraints", "rewrite_preservation")
CATEGORIES = (
    "entity_ambiguity", "pronoun_grounding", "implicit_local_edit", "over_search_negative", "under_search",
    "mask_granularity", "multiple_constraints", "compositional_edit", "rewrite_preservation",
)

# Words that a rewritten request must keep, by group, and what they are counted as.
PROTECTED_TERM_GROUPS = (
    ("black", "blue", "brown", "cyan", "gold", "golden", "gray", "grey", "green", "orange", "pink", "purple", "red", "silver", "teal", "white", "yellow"),
    ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"),
    ("above", "below", "behind", "beside", "between", "bottom", "center", "centre", "foreground", "left", "right", "top"),
    ("large", "long", "narrow", "short", "small", "tall", "tiny", "vertical", "wide"),
    ("brick", "cardboard", "chrome", "fabric", "glass", "leather", "metal", "plastic", "stone", "wooden"),
)
CONSTRAINT_ALIASES = {
    "big": "large", "centered": "center", "centred": "center", "centrally": "center", "centre": "center", "golden": "gold",
    "gray": "grey", "metallic": "metal", "middle": "center", "under": "below", "wood": "wooden",
}

# Words that express a subtask's action.
ACTION_TERMS = {
    "add_object": ("add", "attach", "hang", "insert", "mount", "place", "put"),
    "remove_object": ("clear", "delete", "erase", "get rid", "remove", "take away"),
    "replace_object": ("change", "make", "replace", "swap", "turn"),
    "change_background": ("background", "move", "scene", "set"),
    "change_color": ("color", "colour", "make", "turn"),
    "global_style": ("look", "render", "style"),
    "change_weather": ("fog", "rain", "snow", "weather"),
    "add_effect": ("add", "effect", "sparkle"),
    "camera_edit": ("camera", "pan", "zoom"),
}
COMBINED_ACTION_GROUPS = {
    "add": ("add", "attach", "hang", "insert", "mount", "place", "put"),
    "remove": ("clear", "delete", "erase", "get rid", "remove", "take away"),
    "replace": ("replace", "swap", "substitute"),
    "transform": ("change", "make", "paint", "recolor", "turn"),
}

# Words that name no particular thing to search for, or no part to mask.
SEARCH_STOPWORDS = (
    "a", "an", "and", "bag", "bottle", "camera", "car", "chair", "console", "cup", "for", "image", "object", "of",
    "reference", "shoe", "sneaker", "statue", "the", "toy", "tree", "with",
)
MASK_STOPWORDS = (*SEARCH_STOPWORDS, "area", "at", "frame", "from", "in", "located", "on", "scene", "to")

# Axes of the frame rubric with the labels that a judge writes, the two that need a named entity, and the edits without one.
RUBRIC_AXES = {
    "instruction_following": "Instruction Following",
    "edit_region_localization": "Edit Region Localization",
    "source_preservation": "Source Preservation",
    "visual_quality": "Visual Quality",
    "temporal_consistency": "Temporal Consistency",
    "ip_presence": "IP Presence",
    "ip_identity_match": "IP Identity Match",
}
ENTITY_AXES = ("ip_presence", "ip_identity_match")
EDITS_WITHOUT_ENTITY = ("reasoning", "removal")

# Wording of requests that results must have.
#: Verbs at the beginning of a request, and what is said instead; a please before them goes.
REWORDINGS = {"Remove": "get rid of", "Add": "put", "Replace": "swap", "Change": "make"}
POLITE = "please"
#: Words that point at something.
GROUNDING_PHRASES = ("it", "this", "that", "this one", "that one", "the one")
#: Lines of the checklist that a rewriter gets.
KEEP_TERM = "retain the concept '{value}'"
KEEP_ACTION = "express the '{}' edit action"
KEEP_PRONOUN = "use a demonstrative or grounding pronoun such as 'that', 'this', or 'the one'"
KEEP_IDENTITY = "name the searched identity '{value}'"
KEEP_MASK = "identify the mask target with these details: {value}"
