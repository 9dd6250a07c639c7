"""Fixed vocabulary of the survey: levels, codes, conditions, items, states and patterns.

Fixed values: the levels, code names, item keys, quota counts and patterns below are part of the data formats and
must be as they stand.
"""

from __future__ import annotations

from functools import lru_cache

SURVEY_YEAR = 2026

MODERATORS = {
    "gender": ["Male", "Female", "Other"],
    "age_band": ["18-29", "30-44", "45-59", "60+"],
    "race": ["White / Caucasian", "Black / African American", "Hispanic / Latino", "Asian / Asian American", "Other"],
    "education": ["Less than high school", "High school diploma / GED", "Some college or Associate's degree", "Bachelor's degree", "Master's degree / Professional degree", "Doctorate degree / Ph.D."],
    "income": ["Less than $30,000", "$30,000 to $55,999", "$56,000 to $99,999", "$100,000 to $167,999", "$168,000 or more"],
    "party": ["Republican", "Democrat", "Independent", "Other"],
}
#: Upper age of each band but the last, and the age that stands for a band.
AGE_EDGES = (29, 44, 59)
BAND_AGE = {"18-29": 24, "30-44": 37, "45-59": 52, "60+": 68}

CONTROL = "control"
INTERVENTIONS = [
    "Corporate reliance", "Social justice", "Interview Prof. Maraun", "Funding", "Oil industry misinformation", "Measurement & modeling (1)", "Former skeptics", "High public trust",
    "Measurement & modeling (2)", "Peer-review", "Scientist community helpers", "Consensus", "Portrait Prof. Cherry", "Model accuracy", "Interview Prof. Sebille", "Extreme weather predictions",
]
CONDITIONS = [CONTROL, *INTERVENTIONS]
CODENAMES = {
    "control neckties": CONTROL, "control baseball": CONTROL, "control dances": CONTROL,
    "practical planarian": "Extreme weather predictions", "complicated cockroach": "Portrait Prof. Cherry", "flimsy fish": "Interview Prof. Maraun", "honored haddock": "Peer-review",
    "jealous jaguar": "Consensus", "phony parrotfish": "Funding", "crushing chicken; gross grasshopper; homely halibut": "High public trust", "worse wildfowl": "Oil industry misinformation",
    "periwinkle partridge": "Scientist community helpers", "difficult dog": "Social justice", "giant gibbon; brick bobcat": "Corporate reliance", "limping llama; friendly frog": "Former skeptics",
    "perfect prawn": "Measurement & modeling (1)", "orchid orangutan; defiant dragonfly": "Measurement & modeling (2)", "apple aardvark": "Model accuracy",
        "heartfelt hummingbird": "Interview Prof. Sebille",
}
CONTROL_FILLERS = ["control neckties", "control baseball", "control dances"]

#: Blocks of outcome items: (order group, block key, item keys).  Groups: 1 first, then 2 and 3, each in random order.
BLOCKS = [
    (1, "trust_multidimensional", ["trust_competent_1", "trust_intelligent_1", "trust_qualified_1", "trust_honest_1", "trust_ethical_1", "trust_sincere_1",
        "trust_concerned_1", "trust_improve_1", "trust_considerate_1", "trust_feedback_1", "trust_transparent_1", "trust_attention_1"]),
    (2, "trust_single_post", ["trust_post_1"]),
    (2, "donation", ["donation"]),
    (2, "distrust_single_post", ["distrust_1"]),
    (2, "scientists_role_in_policy", ["policy_1_1", "policy_2_1", "policy_3_1", "policy_4_1"]),
    (2, "funding", ["funding_5"]),
    (2, "institutional_trust", ["inst_trust_epa_1", "inst_trust_nasa_1", "inst_trust_noaa_1", "inst_trust_uni_1", "inst_trust_gov_1"]),
    (2, "subscription_newsletter", ["newsletter"]),
    (3, "belief_post", ["belief_post_1"]),
    (3, "climate_change_concern", ["concern_1_1", "concern_2_1", "concern_3_1"]),
    (3, "individual_level_behavior", ["individual_meat_1", "individual_transport_1", "individual_solar_1", "individual_fly_1", "individual_talk_1", "individual_donate_1"]),
    (3, "support_general_climate_policies", ["policy_general_1"]),
    (3, "support_specific_climate_policies", [f"policy_specific_{i}_1" for i in range(1, 8)]),
]
PRE_BLOCKS = [("belief_pre", ["belief_pre"]), ("trust_single_pre", ["trust_pre"])]
#: Blocks with a page of their own before their items.
PRE_PAGES = {"donation", "subscription_newsletter"}
ITEM_KEYS = [k for _, _, keys in BLOCKS for k in keys]
#: Choice items: (symbol, label, exported value); all others are sliders from 0 to 100.
CHOICES = {
    "donation": [(f"Don{d}", f"${d}", d) for d in range(11)],
    "newsletter": [("News1", "Yes", 1), ("News2", "No", 2)],
}
#: Titles that aren't the item's key in capitals without its last number.
TITLES = {
    "trust_post_1": "TRUST_POST", "distrust_1": "DISTRUST", "funding_5": "FUNDING_PERCEPTION", "donation": "DONATION", "newsletter": "NEWSLETTER", "belief_post_1": "BELIEF_POST",
    "inst_trust_uni_1": "INST_TRUST_UNIVERSITIES", "inst_trust_gov_1": "INST_TRUST_FEDERAL_GOV", "belief_pre": "BELIEF_PRE", "trust_pre": "TRUST_PRE",
    **{f"policy_{i}_1": f"POLICY_ROLE_{i}" for i in range(1, 5)}, **{f"individual_{x}_1": f"BEHAVIOR_{x.upper()}" for x in ("meat", "transport", "solar", "fly", "talk", "donate")},
}


@lru_cache(4096)
def title(key: str) -> str:
    return TITLES.get(key) or key.upper().removesuffix("_1")


#: Items that some conditions ask before the battery; they are recorded but not scored.
ELICITATION_ITEMS = ["funding_value_1", "funding_value_2", "funding_value_3", "funding_value_4", "funding_paid", "funding_federal", "funding_private",
    "public_trust_estimate", "consensus_human", "consensus_co2", "consensus_year"]

#: Composites: target column -> groups of item keys (a mean of group means).
COMPOSITES = {
    "trust_multidimensional": [ITEM_KEYS[0:3], ITEM_KEYS[3:6], ITEM_KEYS[6:9], ITEM_KEYS[9:12]],
    "policy_role_mean": [[f"policy_{i}_1" for i in range(1, 5)]],
    "inst_trust_mean": [[f"inst_trust_{x}_1" for x in ("epa", "nasa", "noaa", "uni", "gov")]],
    "concern_mean": [[f"concern_{i}_1" for i in range(1, 4)]],
    "policy_specific_mean": [[f"policy_specific_{i}_1" for i in range(1, 8)]],
    "behavior_mean": [[f"individual_{x}_1" for x in ("meat", "transport", "solar", "fly", "talk", "donate")]],
}
SINGLES = {"trust_post": "trust_post_1", "distrust_post": "distrust_1", "belief_post": "belief_post_1", "policy_general": "policy_general_1"}
#: The 13 outcomes and their ranges.
OUTCOMES = {
    "trust_multidimensional": (0, 100), "trust_post": (0, 100), "distrust_post": (0, 100), "belief_post": (0, 100), "policy_general": (0, 100), "funding_perceptions": (0, 100),
    "policy_role_mean": (0, 100), "inst_trust_mean": (0, 100), "concern_mean": (0, 100), "policy_specific_mean": (0, 100), "behavior_mean": (0, 100),
        "donation_ams": (0, 10), "newsletter_signup": (0, 1),
}

STATE_CASES = {
    1: ["Alabama", "Arkansas", "Delaware", "Florida", "Georgia", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maryland", "Mississippi", "Missouri",
        "Nebraska", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Pennsylvania", "South Carolina", "South Dakota", "Tennessee", "Texas", "Virginia", "West Virginia", "Washington, D.C."],
    2: ["Alaska", "Arizona", "California", "Colorado", "Idaho", "Montana", "Nevada", "New Mexico", "Oregon", "Utah", "Washington", "Wyoming", "Hawaii"],
    3: ["Connecticut", "Maine", "Massachusetts", "Michigan", "Minnesota", "New Hampshire", "New Jersey", "New York", "Rhode Island", "Vermont", "Wisconsin"],
}
STATE_CODES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida",
        "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
        "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
        "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
        "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "Washington, D.C.",
}
STATE_ALIASES = {"washington dc": "Washington, D.C.", "washington d.c.": "Washington, D.C.", "washington, dc": "Washington, D.C.",
    "district of columbia": "Washington, D.C.", "dc": "Washington, D.C.", "d.c.": "Washington, D.C."}

#: Quota counts: (age band or race, gender) -> people.
AGE_GENDER_COUNTS = {
    ("18-29", "Male"): 1848, ("18-29", "Female"): 1781, ("30-44", "Male"): 2365, ("30-44", "Female"): 2323,
    ("45-59", "Male"): 2048, ("45-59", "Female"): 2074, ("60+", "Male"): 2566, ("60+", "Female"): 2995,
}
RACE_GENDER_COUNTS = {
    ("Asian / Asian American", "Male"): 568, ("Asian / Asian American", "Female"): 633, ("Black / African American", "Male"): 1042, ("Black / African American", "Female"): 1170,
    ("Hispanic / Latino", "Male"): 1646, ("Hispanic / Latino", "Female"): 1617, ("Other", "Male"): 240, ("Other", "Female"): 252, ("White / Caucasian", "Male"): 5332,
        ("White / Caucasian", "Female"): 5500,
}

#: Linguistic cues of a reply.
CUES = {
    "question": r"\b(who|what|when|where|why|how|which)\b|\?",
    "second_person": r"\b(you|you're|youre|your|ur)\b",
    "disagreement": r"\b(but|however|no|nah|disagree|wrong|incorrect|actually)\b",
    "booster": r"\b(obviously|clearly|honestly|frankly|surely|of course)\b",
    "agreement": r"\b(agree|agreed|exactly|this[\s.,!]|totally|absolutely|100%|yes|yeah|yep|precisely|well said|couldn't agree more|nailed it|spot on)\b",
    "concession": r"\b(fair point|fair enough|good point|you('re| are) right|that's true|i stand corrected|touch[ée]|didn't (know|realize|consider) that|changed my mind|TIL)\b",
    "hedge": r"\b(i think|i believe|maybe|perhaps|possibly|not sure|i guess|kind of|sort of|might be|could be|as far as i know|afaik|i'm not (certain|100%|entirely sure))\b",
    "elaboration": r"\b(also|additionally|furthermore|moreover|to add|worth (noting|mentioning)|another (thing|point|reason)|on top of that|building on)\b",
    "evidence_marker": r"\b(source|according to|study|studies|research shows|data shows|citation|link|read that|article|paper)\b|https?://",
    "clarification_request": r"\b(what do you mean|can you (clarify|explain|elaborate)|not sure (i|what) (understand|you mean)|could you expand)\b",
    "personal_experience": r"\b(i've|i have|in my experience|i work(ed)? (in|as)|as a\b|when i|i once|i used to)\b",
    "quotes_parent": r"(?m)^>",
}
#: Signs that a model declines to answer.
REFUSALS = [
    r"\bI\s+(?:cannot|can't|won't|will not)\b",
    r"\bI\s*(?:'m| am)\s+(?:not able|unable)\b",
    r"\bI must decline\b",
    r"\bI\s*(?:'m| am)\s+sorry,?\s+but\b",
    r"\bI\s+(?:don't|do not)\s+feel comfortable\b",
    r"\b(?:unable|not able) to\s+(?:speculate|infer|provide|determine|guess|make (?:this|any|such) (?:assumption|inference))",
    r"\bnot appropriate (?:for me )?to\b",
    r"\bethical(?:ly)?\s+(?:concerns?|issues?|reasons?|guidelines)\b",
    r"\bviolat\w*\s+(?:my |the )?(?:guidelines|policy|policies)\b",
    r"\bas an AI\b",
    r"\brefuse to\b",
    r"\bagainst my\s+(?:guidelines|programming|principles)\b",
    r"\bnot something I (?:can|will|would)\b",
    r"\bcannot (?:make|draw)\s+(?:assumptions|inferences|conclusions)\s+about\s+(?:real|actual)\s+(?:people|individuals|persons)\b",
    r"\bprivacy concerns?\b",
]
