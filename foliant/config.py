"""Settings and lexicons, immutable; queries may pass others."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists and settings that results depend on.

VEGETARIAN = ("vegetarian", "vegan", "plant-based", "veggie")
GLUTEN_FREE = ("gluten-free", "gluten free", "celiac", "wheat-free")
NON_VEGETARIAN = (
    "meat", "beef", "pork", "chicken", "fish", "seafood", "lamb",
    "turkey", "bacon", "sausage", "ham", "salmon", "tuna", "shrimp",
    "crab", "lobster", "scallops", "mussels", "oysters", "clams",
    "duck", "goose", "quail", "poultry", "wing", "drumstick",
    "breast", "thigh", "giblets", "liver", "kidney",
    "steak", "roast", "ground beef", "mince", "veal", "venison",
    "bison", "elk", "rabbit", "goat", "mutton",
    "pepperoni", "salami", "chorizo", "prosciutto", "pastrami",
    "bologna", "hot dog", "bratwurst", "kielbasa", "mortadella",
    "anchovy", "sardine", "mackerel", "cod", "halibut", "bass",
    "trout", "catfish", "tilapia", "swordfish", "eel", "octopus",
    "squid", "calamari", "caviar", "roe",
    "gelatin", "lard", "tallow", "suet", "bone marrow", "blood",
    "rennet", "isinglass", "cochineal", "carmine",
    "grilled chicken", "fried fish", "roasted beef", "smoked salmon",
    "barbecued", "broiled fish", "pan-seared", "braised meat",
)
GLUTEN = ("wheat", "flour", "bread", "pasta", "gluten", "barley", "rye", "beer", "malt", "cereal", "crackers", "cookies")
CORPORATE_CONTEXT = ("corporate", "business", "professional", "office")
CORPORATE_INAPPROPRIATE = (
    "alcohol", "wine", "beer", "cocktail", "drink", "bar", "pub", "party", "celebration", "festive", "holiday specific",
)
PERSONA_KEYWORDS = (
    "vegetarian", "buffet", "travel", "form", "gluten-free", "menu", "trip", "accommodation", "hotel", "restaurant",
    "activity", "compliance", "onboarding",
)
TRIVIAL_TITLES = (
    "ingredients", "instructions", "directions", "steps", "method", "notes", "tip", "tips", "serves", "prep time",
    "cook time", "garnish", "serve", "yield",
)
TRIVIAL_HEADINGS = ("introduction", "conclusion", "summary", "overview", "notes", "references")
GENERIC_TITLES = (
    "ingredients", "directions", "instructions", "step", "note", "tip", "1/", "2/", "3/", "4/", "cup", "tablespoon",
    "teaspoon", "minutes", "serves", "prep time", "cook time", "temperature",
)
INFORMATIVE = (
    "explore", "discover", "experience", "enjoy", "visit", "try", "recommend", "suggest", "perfect", "ideal",
    "beautiful", "stunning", "popular", "famous", "known", "located", "situated", "features",
)
DIVERSITY_TOPICS = {
    "location": ("place", "area", "region", "town", "city", "village"),
    "activities": ("activity", "tour", "adventure", "experience", "excursion"),
    "dining": ("restaurant", "food", "cuisine", "dining", "meal"),
    "culture": ("culture", "art", "museum", "history", "tradition"),
    "accommodation": ("hotel", "stay", "accommodation", "resort"),
    "practical": ("tip", "advice", "important", "remember", "note"),
}
CONTEXT_TOPICS = {
    "location": ("place", "location", "area", "region", "district", "neighborhood", "town", "city"),
    "activities": ("activity", "tour", "visit", "explore", "experience", "adventure", "excursion"),
    "dining": ("restaurant", "food", "cuisine", "dining", "eat", "meal", "taste", "chef", "menu"),
    "accommodation": ("hotel", "accommodation", "stay", "room", "resort", "lodge", "inn"),
    "culture": ("culture", "art", "museum", "history", "tradition", "heritage", "historic"),
    "practical": ("tip", "advice", "recommend", "suggest", "important", "note", "remember"),
}
SENTENCE_TOPICS = {
    "location_description": ("located", "situated", "place", "area", "region", "beautiful", "stunning"),
    "activities": ("explore", "visit", "experience", "enjoy", "discover", "adventure", "tour"),
    "practical_info": ("open", "hours", "cost", "price", "ticket", "admission", "access", "transportation"),
    "dining": ("restaurant", "food", "cuisine", "dining", "taste", "chef", "menu", "meal"),
    "accommodation": ("hotel", "stay", "room", "accommodation", "resort", "lodge"),
    "cultural": ("culture", "art", "museum", "history", "tradition", "heritage", "historic"),
}
RECIPE_KEYWORDS = (
    "ingredients", "recipe", "cook", "bake", "prepare", "dish", "meal", "serves", "prep time", "cook time", "minutes",
    "cup", "tablespoon", "teaspoon", "oven", "temperature", "degrees", "mix", "stir", "add",
)
FOOD_CONTEXT = ("food", "menu", "recipe", "cooking", "chef", "kitchen", "meal", "dish", "buffet")
RECIPE_TITLES = ("recipe", "ingredients", "instructions", "dish", "meal")
RECIPE_SECTION_TITLES = ("recipe", "ingredients", "instructions")
DOCUMENT_INGREDIENT_CUES = ("ingredient", "ingredients:")
DOCUMENT_INSTRUCTION_CUES = ("instruction", "instructions:", "method", "directions:", "preparation")
PASSAGE_INGREDIENT_CUES = ("ingredient", "ingredients:", "items needed", "you will need")
PASSAGE_INSTRUCTION_CUES = ("instruction", "instructions:", "method", "directions:", "steps:", "preparation")
BONUS_INGREDIENT_CUES = ("ingredient", "ingredients:")
BONUS_INSTRUCTION_CUES = ("instruction", "instructions:", "method", "directions")
COOKING_DETAILS = ("temperature", "time", "minutes", "degrees", "cup", "tablespoon", "teaspoon")
COOKING_TERMS = ("ingredients", "instructions", "recipe", "cook", "bake", "prepare", "serve")
ADVICE = (
    "recommend", "suggest", "perfect for", "ideal for", "best time", "make sure", "don't miss", "worth visiting", "must see",
)
TRAVEL_VALUE = (
    "explore", "visit", "discover", "experience", "enjoy", "see", "try", "beautiful", "stunning", "perfect", "ideal",
    "popular", "famous", "recommend", "suggest", "located", "situated", "features", "offers",
)
RECIPE_VALUE = (
    "prepare", "cook", "bake", "mix", "serve", "recipe", "dish", "meal", "flavor", "taste", "delicious", "nutritious",
    "healthy", "fresh", "ingredients", "season", "garnish", "texture", "aroma",
)
TECHNICAL_VALUE = (
    "feature", "function", "process", "method", "step", "procedure", "important", "required", "complete", "configure",
    "enable", "access", "click", "select", "choose", "open", "create", "save", "export",
)
GENERIC_FRAGMENTS = (
    "see above", "see below", "as mentioned", "refer to", "page", "figure", "table", "chart", "note:", "tip:",
    "warning:", "step 1", "step 2", "step 3", "item 1", "item 2",
)
RECIPE_FOODS = (
    "pancake", "egg", "toast", "smoothie", "avocado", "omelette", "omelet",
    "oatmeal", "yogurt", "muffin", "chia", "french toast", "scrambled",
    "bacon", "sausage", "cheese", "bread", "flour", "banana", "berry",
    "pasta", "rice", "chicken", "beef", "fish", "salmon", "tuna",
    "salad", "soup", "sandwich", "wrap", "burrito", "pizza", "quinoa",
    "lentil", "bean", "tofu", "mushroom", "spinach", "broccoli", "carrot",
    "potato", "sweet potato", "tomato", "pepper", "onion", "garlic",
)
COOKING_METHODS = ("baked", "grilled", "fried", "roasted", "steamed", "sautéed")
PASSAGE_DELIMITERS = ("  ", "\n\n", ". ", "! ", "? ")


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds, weights and caps of sectioning, ranking and passage selection."""

    min_section_length: int = 200
    min_section_words: int = 30
    min_content_blocks: int = 3
    max_content_blocks: int = 10
    generic_title_penalty: float = -0.3
    fragment_penalty: float = -0.2
    short_content_penalty: float = -0.1
    diversity_weight: float = 0.2
    informativeness_weight: float = 0.5
    title_penalty: float = -0.3
    keyword_boost: float = 0.2
    persona_weight: float = 0.5
    job_weight: float = 0.5
    input_sections: int = 200
    ranked_sections: int = 100
    passage_sections: int = 30
    sections_per_document: int = 15
    fallback_sections: int = 5
    min_passage_length: int = 100
    target_passage_length: int = 300
    max_passage_length: int = 600
    min_information_density: int = 2
    min_unique_tokens: int = 8
    min_sentence_count: int = 1
    passage_persona_weight: float = 0.4
    passage_job_weight: float = 0.6
    duplicate_threshold: float = 0.88
    passages_per_section: int = 2
    passages_per_collection: int = 20
    recipe_min_length: int = 80
    recipe_target_length: int = 250
    recipe_max_length: int = 500
    recipe_ratio: float = 0.08
    min_recipe_text: int = 100
    min_recipe_words: int = 15
    font_jump: float = 1.5
    line_gap: float = 18.0
    block_distance: float = 40.0
    heading_weight: int = 700
    min_group_blocks: int = 2
    embedded_characters: int = 512
    dimensions: int = 64
    #: ``hashing``, or where a sentence model is.
    embedding_model_path: str = "hashing"
    max_processing_seconds: float = 60.0
    persona_keywords: tuple[str, ...] = PERSONA_KEYWORDS
    trivial_titles: tuple[str, ...] = TRIVIAL_TITLES
    informative: tuple[str, ...] = INFORMATIVE
    topics: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DIVERSITY_TOPICS))
    value_terms: tuple[str, ...] = (*TRAVEL_VALUE, *RECIPE_VALUE, *TECHNICAL_VALUE)


DEFAULT = EngineConfig()
