"""Schemas of raw input and of the relations that the operators read."""

#: The fields of raw input.
RAW_REVIEW = "name string, stars double, text string, publishedAtDate string, likesCount bigint"
RAW_PLACE = (
    "title string, address string, totalScore double, reviewsCount bigint, categoryName string, categories array<string>, description string, "
    "price string, openingHours array<struct<day: string, hours: string>>, website string, phone string, locationType string, "
    f"permanentlyClosed boolean, temporarilyClosed boolean, reviews array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in RAW_REVIEW.split(', ')))}>>"
)
REVIEWS = "place_id string, pos int, author string, rating double, text string, date string, likes bigint"
PER_REVIEW = "place_id string, batch int, id string, sentiment string, score double, emotion string, intensity string, key_phrase string"
ASPECTS = "place_id string, batch int, aspect string, score double, reviews_mentioning bigint, summary string, evidence_review_ids array<string>"
THEMES = "place_id string, batch int, ord int, name string, sentiment string, frequency bigint, representative_quote string, evidence string, evidence_review_ids array<string>"
POINTS = "place_id string, batch int, ord int, polarity string, claim string, aspect string, evidence_review_ids array<string>"
CORRECTIONS = "place_id string, idx int, field string, original_claim string, corrected_claim string, reason string, evidence_review_ids array<string>"
BATCHES = (
    "place_id string, batch int, sentiment_score double, overall_sentiment string, positive_keywords array<string>, negative_keywords array<string>, standout_positive_quote string, standout_negative_quote string, "
    "crowd_profile struct<dominant_visitor_type: string, mention_evidence: string, accessibility_notes: string>, "
    "temporal_trend struct<recent_sentiment: string, recent_score: double, older_sentiment: string, older_score: double, trend: string, trend_explanation: string>"
)
#: What batches may say besides: their mood, how often each emotion comes, and how far reviews differ.
BATCH_EXTRAS = "emotional_tone string, emotion_distribution map<string, bigint>, review_diversity string"
FACTS = "place_id string, fact_no int, fact string"
EVIDENCE = "place_id string, ord int, aspect string, evidence string, confidence double, severity string, supporting_review_ids array<string>"
GUARDRAIL = "place_id string, trust_score double, fake_review_probability double"
PATTERNS = "place_id string, ord int, pattern string"
SECTIONS = "place_id string, section string, status string, observations array<string>, issues array<string>, unsupported_claims array<string>"
CONCERN = "aspect string, evidence string, severity string, supporting_review_ids array<string>, source string"
GEO_FEATURES = "ord int, name string, city string, town string, village string, county string, state string, country string, type string, osm_key string, osm_value string, coordinates array<double>"

#: The aspects in order with their weights in the aspect component.
ASPECT_WEIGHTS = {"food_quality": 1.5, "service": 1.5, "ambience": 1.2, "value_for_money": 1.0, "cleanliness": 1.0, "accessibility": 0.5, "crowd_wait_time": 0.8}
ASPECT_NAMES = ("food_quality", "service", "ambience", "value_for_money", "cleanliness", "accessibility", "crowd_wait_time")
EMOTIONS = ("Excited", "Happy", "Satisfied", "Neutral", "Disappointed", "Frustrated", "Angry")
#: Words of a place's category to its icon, in order of precedence.
CATEGORY_ICONS = {
    "restaurant": "🍽️", "food": "🍽️", "cafe": "☕", "coffee": "☕", "bar": "🍺", "pub": "🍺", "bakery": "🥐", "pizza": "🍕",
    "hotel": "🏨", "lodge": "🏨", "resort": "🏨", "mall": "🛍️", "shopping": "🛍️", "store": "🛒", "market": "🛒",
    "cinema": "🎬", "theatre": "🎭", "theater": "🎭", "movie": "🎬", "museum": "🏛️", "gallery": "🖼️", "art": "🖼️",
    "park": "🌳", "garden": "🌿", "beach": "🏖️", "nature": "🌿", "temple": "🛕", "church": "⛪", "mosque": "🕌", "religious": "🙏",
    "hospital": "🏥", "clinic": "🏥", "pharmacy": "💊", "gym": "💪", "fitness": "💪", "sport": "⚽", "stadium": "🏟️",
    "spa": "💆", "salon": "💇", "beauty": "💅", "school": "🏫", "university": "🎓", "college": "🎓", "bank": "🏦", "atm": "🏧",
    "airport": "✈️", "station": "🚉", "amusement": "🎡", "zoo": "🦁", "aquarium": "🐠", "monument": "🗽", "landmark": "🏛️", "historic": "🏰",
}
DEFAULT_ICON = "📍"
#: Kinds of geocoder features that count as cities.
CITY_TYPES = ("city", "town", "village", "municipality", "borough", "suburb", "district", "county", "state", "administrative")
