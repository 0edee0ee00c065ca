"""Fixed values of English suffix stripping (the published Snowball English rules).

Rows of a step are tried in order, longest suffix first; the first whose suffix fits decides the
step, whether its region holds or not. Regions are counted in letters from the start of the word.
"""

# --- FIXED VALUES: words that the rules do not touch, or touch wrongly --------------
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
           "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news",
           "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION_PREFIXES = ["gener", "commun", "arsen"]

# --- FIXED VALUES: (suffix, replacement, letters that must come before) -------------
STEP_2 = [("ational", "ate", ""), ("fulness", "ful", ""), ("iveness", "ive", ""), ("ization", "ize", ""),
          ("ousness", "ous", ""), ("biliti", "ble", ""), ("lessli", "less", ""), ("tional", "tion", ""),
          ("alism", "al", ""), ("aliti", "al", ""), ("ation", "ate", ""), ("entli", "ent", ""), ("fulli", "ful", ""),
          ("iviti", "ive", ""), ("ousli", "ous", ""), ("abli", "able", ""), ("alli", "al", ""), ("anci", "ance", ""),
          ("ator", "ate", ""), ("enci", "ence", ""), ("izer", "ize", ""), ("bli", "ble", ""), ("ogi", "og", "l"),
          ("li", "", "cdeghkmnrt")]
STEP_3 = [("ational", "ate", 1), ("tional", "tion", 1), ("alize", "al", 1), ("ative", "", 2), ("icate", "ic", 1),
          ("iciti", "ic", 1), ("ical", "ic", 1), ("ness", "", 1), ("ful", "", 1)]  # with the region
STEP_4 = [("ement", ""), ("able", ""), ("ance", ""), ("ence", ""), ("ible", ""), ("ment", ""), ("ant", ""), ("ate", ""),
          ("ent", ""), ("ion", "st"), ("ism", ""), ("iti", ""), ("ive", ""), ("ize", ""), ("ous", ""), ("al", ""),
          ("er", ""), ("ic", "")]
