"""Taxonomy, rules, maps and query sets. They must equal the published ones for equal results.

A rule is a value and the patterns of which any one must be found; rules stand in order of precedence.
"""

FIELDS = {
    "time_of_day": ["day", "night", "dawn", "dusk"],
    "weather": ["clear", "cloudy", "rain", "snow", "fog"],
    "road_type": ["highway", "urban", "intersection", "parking_lot", "rural", "tunnel", "bridge"],
    "traffic_density": ["free", "moderate", "congested"],
    "agent_type": ["pedestrian", "cyclist", "motorcycle", "truck", "bus", "emergency_vehicle", "animal", "none"],
    "hazard_level": ["none", "low", "medium", "high"],
    "ego_action": ["straight", "left_turn", "right_turn", "uturn", "lane_change", "braking", "stopping", "reversing"],
}
MULTI = ("agent_type", "ego_action")
SINGLE = tuple(f for f in FIELDS if f not in MULTI)

TAG_RULES = {
    "time_of_day": [
        ("night", [r"\bnighttime\b", r"\bnight\b", r"\bnocturnal\b", r"\bafter dark\b", r"\bdarkness\b", r"\bpitch[- ]?black\b", r"\bheadlights?\b", r"\bstreet[- ]?lights?\b"]),
        ("dawn", [r"\bdawn\b", r"\bearly morning\b", r"\bsunrise\b", r"\bfirst light\b", r"\bpre[- ]?dawn\b"]),
        ("dusk", [r"\bdusk\b", r"\bevening\b", r"\bsunset\b", r"\btwilight\b", r"\bnightfall\b", r"\bfading light\b"]),
        ("day", [r"\bdaytime\b", r"\bday\b", r"\bdaylight\b", r"\bsunny\b", r"\bbright\b", r"\bmorning\b", r"\bafternoon\b", r"\bmidday\b", r"\bnoon\b", r"\bwell[- ]?lit\b"]),
    ],
    "weather": [
        ("rain", [r"\brain\b", r"\brainy\b", r"\braining\b", r"\bwet road\b", r"\bshower\b", r"\bdrizzle\b", r"\bprecipitation\b", r"\bdownpour\b", r"\bpuddles?\b"]),
        ("fog", [r"\bfog\b", r"\bfoggy\b", r"\bvisibility\b.*poor", r"\bpoor visibility\b", r"\bmist\b", r"\bmisty\b", r"\bhaze\b", r"\bhazy\b", r"\blow[- ]?visibility\b"]),
        ("snow", [r"\bsnow\b", r"\bsnowy\b", r"\bice\b", r"\bicy\b", r"\bwinter condition\b", r"\bsleet\b", r"\bfrost\b", r"\bblack ice\b", r"\bslippery\b"]),
        ("cloudy", [r"\bcloudy\b", r"\bovercast\b", r"\bgloomy\b"]),
        ("clear", [r"\bclear\b", r"\bfair\b", r"\bdry road\b"]),
    ],
    "road_type": [
        ("highway", [r"\bhighway\b", r"\bfreeway\b", r"\bmotorway\b", r"\bexpressway\b", r"\binterstate\b"]),
        ("intersection", [r"\bintersection\b", r"\bjunction\b", r"\bcrossroad\b", r"\btraffic light\b", r"\bstop sign\b", r"\btraffic signal\b"]),
        ("parking_lot", [r"\bparking\b", r"\bparked\b", r"\bparking lot\b", r"\bparking area\b"]),
        ("tunnel", [r"\btunnel\b"]),
        ("bridge", [r"\bbridge\b", r"\boverpass\b"]),
        ("urban", [r"\burban\b", r"\bcity\b", r"\bstreet\b", r"\bblock\b", r"\bboulevard\b", r"\bavenue\b"]),
        ("rural", [r"\brural\b", r"\bcountry road\b", r"\bfarm\b", r"\bfield\b"]),
    ],
    "traffic_density": [
        ("congested", [r"\bcongested\b", r"\bheavy traffic\b", r"\btraffic jam\b", r"\bbumper[- ]to[- ]bumper\b", r"\bqueue\b", r"\bslow[- ]?moving\b", r"\bstop[- ]and[- ]go\b", r"\bbacked[- ]?up\b", r"\bstandstill\b", r"\bgridlock\b", r"\bdense traffic\b", r"\bcrawling\b"]),
        ("moderate", [r"\bmoderate traffic\b", r"\bsome traffic\b", r"\bseveral vehicles\b", r"\bsteady traffic\b", r"\bmoving vehicles\b"]),
        ("free", [r"\blight traffic\b", r"\bfree[- ]flowing\b", r"\bminimal traffic\b", r"\bempty road\b", r"\bopen road\b", r"\bsparse traffic\b", r"\bno traffic\b", r"\bdeserted\b"]),
    ],
    "agent_type": [
        ("pedestrian", [r"\bpedestrian\b", r"\bwalker\b", r"\bperson crossing\b", r"\bpeople crossing\b"]),
        ("cyclist", [r"\bcyclist\b", r"\bbicycle\b", r"\bbike\b"]),
        ("motorcycle", [r"\bmotorcycle\b", r"\bmotorbike\b", r"\bscooter\b"]),
        ("truck", [r"\btruck\b", r"\blorry\b", r"\btrailer\b", r"\bsemi[- ]truck\b"]),
        ("bus", [r"\bbus\b"]),
        ("emergency_vehicle", [r"\bambulance\b", r"\bfire truck\b", r"\bpolice car\b", r"\bemergency vehicle\b"]),
        ("animal", [r"\bdog\b", r"\bcat\b", r"\banimal\b", r"\bwildlife\b"]),
    ],
    "hazard_level": [
        ("high", [r"\bhazard\b", r"\bdanger\b", r"\bcollision\b", r"\bcrash\b", r"\baccident\b", r"\bemergency brake\b", r"\bsudden stop\b", r"\bimminent\b", r"\bnear[- ]?miss\b", r"\bclose[- ]?call\b", r"\baggressive driving\b", r"\bswerved?\b", r"\breckless\b"]),
        ("medium", [r"\bcaution\b", r"\bcareful\b", r"\bprudent\b", r"\baware\b", r"\bvigilant\b", r"\bslow down\b", r"\brisky\b", r"\berratic\b", r"\bunexpected\b"]),
        ("low", [r"\bsafe\b", r"\bnormal\b", r"\bsmooth\b"]),
        ("none", [r"\bno hazard\b", r"\bno incident\b"]),
    ],
    "ego_action": [
        ("braking", [r"\bbrake\b", r"\bbraking\b", r"\bslows? down\b", r"\breduces? speed\b"]),
        ("stopping", [r"\bstop[ps]?\b", r"\bstands? still\b", r"\bstops? at\b", r"\bhalt\b"]),
        ("left_turn", [r"\bleft turn\b", r"\bturns? left\b"]),
        ("right_turn", [r"\bright turn\b", r"\bturns? right\b"]),
        ("uturn", [r"\bu[- ]?turn\b"]),
        ("lane_change", [r"\blane change\b", r"\bchanges? lane\b", r"\bmerge\b", r"\bmerging\b", r"\bovertake\b"]),
        ("reversing", [r"\breverse\b", r"\breversing\b", r"\bback up\b"]),
        ("straight", [r"\bcontinues?\b", r"\bproceeds?\b", r"\bmaintains? course\b", r"\bstraight\b"]),
    ],
}

#: field, value, substrings of a query
HINT_RULES = [
    ("time_of_day", "night", ["night", "nighttime", "after dark", "poorly lit", "dark"]),
    ("time_of_day", "dawn", ["dawn", "sunrise"]),
    ("time_of_day", "dusk", ["dusk", "sunset", "twilight"]),
    ("weather", "fog", ["fog", "foggy", "mist", "misty", "atmospheric condition"]),
    ("weather", "rain", ["rain", "rainy", "wet road", "heavy rain", "aquaplaning", "slippery surface"]),
    ("weather", "snow", ["snow", "snowy", "icy", "ice", "slippery", "winter", "frost"]),
    ("road_type", "highway", ["highway", "motorway", "freeway", "on-ramp"]),
    ("road_type", "intersection", ["intersection", "crossroads", "crosswalk"]),
    ("road_type", "parking_lot", ["parking lot", "parking"]),
    ("road_type", "tunnel", ["tunnel"]),
    ("road_type", "urban", ["urban", "city street"]),
    ("agent_type", "pedestrian", ["pedestrian", "person walking", "walker", "child", "children", "passenger stepping"]),
    ("agent_type", "cyclist", ["cyclist", "bicycle", "bike", "two-wheeler"]),
    ("agent_type", "truck", ["truck", "freight vehicle", "lorry"]),
    ("agent_type", "bus", ["bus"]),
    ("agent_type", "animal", ["animal", "wildlife"]),
    ("traffic_density", "congested", ["congested", "congestion", "standstill", "heavy traffic", "traffic jam"]),
    ("hazard_level", "high", ["emergency braking", "near-miss", "near miss", "collision", "hard braking", "sudden braking"]),
]

#: dimension, tag field, value -> number; agents are counted instead
DIMENSIONS = ["visibility_level", "precipitation_intensity", "traffic_density_cont", "hazard_proximity", "agent_density", "lighting_level", "road_type_encoded"]
DIMENSION_MAPS = {
    "visibility_level": ("weather", {"fog": 0.12, "rain": 0.60, "snow": 0.50, "cloudy": 0.80, "clear": 0.98}),
    "precipitation_intensity": ("weather", {"fog": 0.05, "rain": 0.65, "snow": 0.72, "cloudy": 0.02, "clear": 0.00}),
    "traffic_density_cont": ("traffic_density", {"congested": 0.85, "moderate": 0.50, "free": 0.10}),
    "hazard_proximity": ("hazard_level", {"high": 0.85, "medium": 0.50, "low": 0.20, "none": 0.03}),
    "lighting_level": ("time_of_day", {"night": 0.08, "dawn": 0.28, "dusk": 0.32, "day": 0.92}),
    "road_type_encoded": ("road_type", {"parking_lot": 0.05, "tunnel": 0.20, "urban": 0.35, "intersection": 0.42, "rural": 0.60, "bridge": 0.70, "highway": 0.92}),
}
#: for no, one, two and more agents
AGENT_DENSITY = (0.05, 0.30, 0.60, 0.85)

PROFILE_KEYWORDS = ["night", "nighttime", "day", "daytime", "highway", "intersection", "urban", "rural", "rain", "fog", "snow", "pedestrian", "cyclist", "truck", "bus", "emergency", "animal", "braking", "stopping", "turning", "lane change", "parking", "tunnel", "bridge", "congested", "moderate traffic", "hazard", "warning", "accident"]

CAUSAL_STEMS = ["caus", "trigger", "lead", "result", "forc", "sudden", "emergency", "collision", "avoid", "brak", "swerv", "slip", "skid"]

#: English stop words of the keyword index
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]

#: level -> queries, numbered from 01 in each level
QUERIES = {
    "L0": ["pedestrian crossing at night intersection", "nighttime driving on poorly lit street", "night urban driving with streetlights", "highway driving with truck overtaking", "highway lane change merging", "highway poor visibility warning sign", "vehicle sudden braking ahead", "emergency braking to avoid collision", "red light stopping intersection", "pedestrian suddenly enters road", "pedestrian crossing with dog", "children near school zone", "foggy conditions reduced visibility", "rainy road wet conditions", "parking lot reversing", "narrow road parked vehicles on both sides", "cyclist entering road unexpectedly", "truck parked blocking lane", "bus stop with passengers", "animal crossing road wildlife"],
    "L1": ["wet road surface after heavy rain", "low visibility due to dense fog", "standstill traffic congestion on highway", "active school zone with speed limit", "construction zone with lane narrowing", "tunnel exit sudden brightness change", "icy slippery road surface in winter", "highway on-ramp merging into fast traffic", "pedestrian crosswalk with active signal", "sharp curve with limited visibility ahead"],
    "L2": ["wet road causes emergency braking near pedestrian", "fog reduces visibility leading to late hazard detection", "pedestrian steps into road triggering swerve and near-miss", "truck cuts in front causing emergency braking and rear-end risk", "slippery road causes loss of control and lane departure", "child runs into road forcing hard braking with tailgating vehicle", "traffic light changes late resulting in intersection conflict", "cyclist wobbles forcing defensive braking with pressure from rear", "animal on road triggers sudden avoidance into oncoming lane", "missed construction sign leads to abrupt lane change and conflict", "poor lighting causes late pedestrian detection requiring emergency stop", "heavy rain causes aquaplaning reducing steering control", "bus stop passenger stepping out triggers braking during merge", "highway merge speed mismatch leads to unsafe gap closing", "sharp curve excess speed requires emergency steering correction"],
    "L3": ["night fog highway truck overtaking high hazard", "rain urban pedestrian crossing bus congested traffic", "dawn icy road sharp curve no guardrail", "dusk school zone cyclist child crosswalk", "tunnel exit night pedestrian narrow road", "heavy fog highway lane change low visibility high speed", "rain intersection red light pedestrian cyclist congested", "snow highway truck emergency braking slippery", "night parking lot reversing pedestrian behind vehicle", "construction zone night lane closure merging congested"],
    "L4": ["vehicle stopped abruptly ahead", "person walking across road after dark", "two-wheeler rider unexpectedly enters lane", "large freight vehicle blocking travel lane", "limited sightlines due to atmospheric conditions"],
}
#: paraphrases
PARAPHRASE_OF = {"L4-01": "L0-07", "L4-02": "L0-01", "L4-03": "L0-17", "L4-04": "L0-18", "L4-05": "L0-13"}

#: queries in the words of the captions
RECIPE_QUERIES = [("R-01", "truck on highway"), ("R-02", "dense fog inside tunnel"), ("R-03", "night pedestrian"), ("R-04", "heavy rain congested lanes"), ("R-05", "collision"), ("R-06", "cyclist brakes")]

#: word lists of the caption recipe
CAPTION_PARTS = {
    "T": ["at night under streetlights", "at dawn", "during dusk", "in bright daylight", "", "in the early morning with headlights on"],
    "W": ["heavy rain", "dense fog", "fresh snow", "an overcast sky", "clear weather", "", "fog and rain"],
    "R": ["on a highway", "near an intersection", "past parked cars", "inside a tunnel", "over a bridge", "along an urban avenue", "on a rural lane", "", "on a highway approaching a junction", "near pedestrians", "in a city block"],
    "D": ["congested lanes", "several vehicles", "an empty road", "", "stop-and-go traffic"],
    "A": ["a pedestrian", "a cyclist", "a motorcycle", "a truck", "a bus", "an ambulance", "a dog", "", "a truck and a bus", "a pedestrian and a cyclist and a dog", "a cyclist and a truck", "no one else", "a scooter"],
    "H": ["a collision is imminent", "caution is needed", "the ride is smooth", "no hazard was seen", "no incident was logged", ""],
    "G": ["brakes then a brake light shows", "comes to a halt", "makes a left turn", "makes a right turn", "makes a u-turn", "starts merging", "is reversing", "goes straight", "", "continues straight and makes a lane change"],
}


def queries() -> list[tuple[str, str, str, str | None]]:
    """qid, level, text, paraphrase_of."""
    return [(qid, level, text, PARAPHRASE_OF.get(qid)) for level, texts in QUERIES.items() for n, text in enumerate(texts, 1) for qid in (f"{level}-{n:02d}",)]
