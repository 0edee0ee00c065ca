"""Code → label lists shown for coded columns (FIXED VALUES, original order)."""

CODE_LABELS: dict[str, dict] = {
    "sex": {"M": "Male", "F": "Female"},
    "ctas": {1: "Life or limb threatening", 2: "Potential thread to life or limb",
             3: "Could progress to serious conditions", 4: "Conditions that require intervention",
             5: "Stable Non-urgent"},
    "intent": {10: "Accident", 11: "Self Harm", 12: "Sexual Abuse/Assault", 13: "Parental Abuse/Neglect",
               14: "Partner Abuse", 15: "Assault (Non-Sexual)", 16: "Undetermined", 19: "Police/Other/Medical"},
    "am_pm": {"a": "AM", "p": "PM"},
    "i_o": {"I": "Inside", "O": "Outside"},
    "sd": {-1: "Unknown", 0: "No Device", 2: "Helmet", 3: "Sports Padding", 4: "Protective Clothing or Boots",
           5: "Eyewear", 6: "Seatbelt", 7: "Carseat", 8: "Airbag (Deployed)", 9: "Not Specified",
           10: "Life Jacket", 11: "Hard Hat", 12: "Mouth Guard", 19: "Baby Gate"},
    "location": {
        11: "patients' own farm house",
        21: "farm house belonging to someone else (including relatives)",
        12: "patients' own home apartment, condo",
        22: "home, apartment or condo belonging to someone else",
        13: "dormitory, school boarding or hostel where the patient is staying",
        23: "someone else's dormitory, school boading or hostel",
        14: "patient's trailer home or motorhome",
        24: "someone else's trailer home or motor home",
        19: "patients' cottage",
        29: "someone else's cottage",
        31: "institutional home, shelter, group home or halfway home",
        32: "retirement or nursing home",
        33: "prison, jail or other detention centers",
        39: "other residential institutions for example ronald mac donald house",
        41: "daycare or preschool",
        42: "school or kindergarden",
        43: "tertiary adult edication for examplel university or military college",
        44: "public administration building like city hall, fire/police station, courthouse",
        45: "place for arts like museum, performance halls, concert hall, library",
        49: "other kinds of institutions like church, military base",
        51: "hospital",
        52: "community health center, detox center, dental office, doctor's office (not in a hospital)",
        61: "amusement park",
        62: "public park",
        63: "aquatic center, like a water park or swimming pool",
        64: "stadium or arena for sports",
        65: "community center",
        66: "fitness center, gym (not in school), martial arts center/dojo, dance studio, ballet school",
        67: "race track for motor sports and horseback",
        68: "other land based sports facility like golf couse, skate park (not ice skating), rodeo grounds",
        69: "water based sports like yatch club, marina, fishing lodge, kayak club, rowing club",
        70: "snow/ice based sports facility like ski resort, ski cabin",
        71: "skate park for ice skating",
        79: "facility for recration like arcade, bowling alley, bingo hall",
        81: "highway",
        82: "other roads like alley, lane, bus stop",
        91: "shop, shopping mall or other commerce centers",
        92: "restaurants, bars, coffee shops",
        93: "entertainment place like bar, night club, casino, strip club",
        94: "airport, train/bus/subway stattion ferry terminal",
        95: "service or gas station for automotives",
        96: "warehouse",
        97: "office building",
        98: "hotel/motel/bed and breakfast, resort",
        109: "other commercial and trade area like bank, laundromat, funeral home, veterenerian office",
        141: "remote undevloped place, swamp, snowmobile track",
        142: "railway tracks not including station",
        143: "camp grounds, trailer park",
        144: "onboard a vehicle like plane, train, bus, ship, ferry",
        111: "construction/demolotion site",
        112: "factory, mill, manufacturing site",
        119: "other industrial area",
        121: "mine, oil or gas well, quarry, sandpit",
        131: "farm, barn, coop but exclduing the farmhouse",
    },
    "area": {
        11: "bathroom, toilet, change room",
        12: "bedroom",
        13: "classroom, daycare indoors",
        14: "dorm room",
        15: "hall, foyer, waiting room, emergency room",
        16: "kitchen",
        17: "laundry room",
        18: "dining area, cafeteria",
        19: "living room, rec room, den",
        20: "office",
        21: "basement",
        22: "spectator area in a church, theatre",
        31: "garage, carport, parking lot",
        32: "workshop",
        33: "agricultural buildings like silo or piggery",
        34: "stable, barn",
        35: "shed",
        36: "other specialized buildings like greenhouse",
        41: "escalator, elevator",
        42: "stairs",
        43: "porch, deck balcony, veranda",
        44: "roof",
        51: "paved road (assume paved unless specified)",
        52: "unpaved road",
        53: "driveway",
        54: "parking lot",
        55: "sidewalk, bus stop",
        56: "median, strip, traffic island",
        57: "tunnel, trench, ditch",
        58: "bike path",
        59: "playground",
        60: "garden, backyard, school yard",
        61: "pasture, field, other outdoor animal area",
        62: "cliff, rock face",
        63: "trails",
        71: "gym, fitness room, yoga studio",
        72: "sports field, track, including indoor spaces",
        73: "tennis, squash etc. court",
        74: "swimming pool",
        75: "ice rink",
        76: "concrete rink for skating",
        77: "locker room, change room",
        78: "splash pad",
        81: "beach, shore, riverbank",
        82: "dam",
        83: "river, lake, creek, pond",
        84: "sea, ocean",
        85: "wharf, dock pier",
        91: "other exterior space, crawlspace, under porch, veranda",
        92: "other interior space like storage, attic etc.",
    },
    "no": {
        10: "superficial bruises, abrasions",
        11: "open wound including minor cuts",
        12: "fracture",
        13: "dislocation",
        14: "sprain or strain",
        15: "injury to nerve",
        16: "injury to blood vessel like hemorrhage",
        17: "injury to muscle or tendon live rupture",
        18: "crushing injury",
        19: "traumatic amputation",
        20: "external burn or corrosion (no eye inj)",
        21: "frostbite",
        22: "insect, animal or human bite",
        23: "electrical injury",
        24: "eye injury including burn or corrosion",
        25: "dental injury",
        26: "injury to internal organs excluding inner ear",
        27: "soft tissue injury",
        31: "foreign body in external eys",
        32: "foreign body in ear canal",
        33: "foreing body in nose",
        34: "foreign body in respiratory tract excluding nose",
        35: "foreign body in digestive tract",
        36: "foreign body in genital, unrinary tract",
        37: "foreing body in soft tissue including splinters",
        41: "minor head injury",
        42: "concussion",
        43: "intracranial injury",
        50: "poisoning or toxic effect",
        51: "drowning, near drowning or immersion",
        52: "asphixia or other treath to breathing",
        53: "overexertion, heat/cold stress",
        60: "multiple injuries of more than one nature",
        70: "no injuries",
        75: "pulled elbow",
        99: "unspecified or no injury",
        76: "internal causitic burn",
        77: "penetrating wound like stabbing or gunshot",
    },
    "bp": {
        110: "head including skull and scalp",
        120: "face",
        130: "internal mouth",
        135: "specific head injury",
        140: "neck excluding spinal cord",
        141: "internal organs in the neck like trachea",
        210: "cervical spine",
        220: "thoracic spine",
        230: "lumber spine",
        240: "sacrum or coccyx",
        250: "other on unspecified spine",
        310: "thorax, ribs, heart, lungs, armpits, trachea",
        315: "upper back excluding scapula",
        321: "abdomen including all abdominal organs",
        322: "lower back",
        323: "pelvis including bladder, bottocks, genitals",
        324: "perineum, external genitalia, scrotum",
        325: "groin",
        330: "unpecified back",
        410: "shoulders, including scapula",
        415: "clavicle",
        420: "upper arm",
        430: "elbow",
        440: "forearm",
        450: "wrist",
        460: "hand",
        470: "finger or thumb",
        510: "hip, including neck of femur",
        520: "thigh, including femur",
        530: "knee",
        540: "lower leg",
        550: "ankle",
        560: "foot",
        570: "toe",
        700: "multiple injuries spanning multipe sections",
        900: "no specific body part including systemic injuries",
        999: "unspecified body part or no injury",
    },
    "sports_code": {1: "yes", 2: "no", 3: "unknown", 4: "not applicable"},
    "sub": {1: "No substances involved", 2: "Substances involved"},
    "disp": {1: "LAMA", 2: "Advice Only", 3: "Treatment in ER w/ PRN follow-up",
             4: "Observation in ER w/ PRN follow-up", 5: "Observation in ER w/ follow-up",
             6: "Treatment with referral for injury", 7: "Admission for injury",
             8: "Admission for other reasons", 9: "DOA or died in ED"},
}


def code_rows() -> list[tuple[str, str, str]]:
    """(column, code as text, label) rows of the decode dimension."""
    return [(c, str(k), v) for c, m in CODE_LABELS.items() for k, v in m.items()]


# The list that decodes a numbered column.
GROUP_OF = {**{f"sd{i}": "sd" for i in range(1, 6)}, **{f"no{i}": "no" for i in range(1, 4)},
            **{f"bp{i}": "bp" for i in range(1, 4)}}
