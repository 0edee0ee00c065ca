"""Fixed values of the injury coding: which words of a diagnosis mean which code.

One row per code, in firing order: the first row that fits wins. ``has`` is any of the words,
``has_all`` all of them, ``lacks`` none of them, as parts of the lower-cased diagnosis.
"""

from caseflow.rules.conditions import has, has_all, lacks, length_is

LOOKUP = "lookup"  # the body part is the one that the body-part rows find

# --- FIXED VALUES: body part codes ------------------------------------------------
BODY_PART_ROWS = [
    (560, (has("foot") & lacks("phalan") | has("metatarsal")) & lacks("toe")),
    (110, has("head") & lacks("radial", "forehead") | has("scalp", "skull")),
    (120, has("mandible") | has("face") & lacks("surface") | has("eyelid", "periocular", "area")
          | has("ear") & lacks("forearm", "frenulum") | has("nose", "mouth", "jaw", "nasal", "facial", "chin", "cheek",
                                                    "eyebrow")
          | has("lip") & lacks("slipped", "frenulum") | has("forehead", "sinus", "orbital", "epistaxis")
          | has_all("nose", "bleed") | has("palsy") | has_all("tympanic", "membrane")),
    (130, has_all("internal", "mouth") | has("palate", "tongue") | has_all("tear", "frenulum", "lip")),
    (140, has("neck") & lacks("femur", "radial", "fibula", "tibula", "fib", "tib", "tibia")),
    (141, has("upper", "impact") & has("esophag") | has("trachea", "pharyngeal", "laryngeal")),
    (210, has("cervical")),
    (220, has("thoracic")),
    (230, has("lumbar")),
    (240, has("sacrum", "coccyx")),
    (250, has("spine")),
    (310, has("thorax", "ribs", "lungs", "armpits", "lower esophagus", "trachea", "chest", "aspirat")),
    (315, has("upper back", "trapeziu")),
    (321, has("abdom", "colon") | has("foreign") & has("ingestion", "intestine") | has("stomach", "kidney")
          | has("sple") & lacks("cyst", "splenomegaly", "disease") | has("gastrointestinal tract", "liver")),
    (322, has("lower back", "flank")),
    (323, has("pelvis", "bladder", "buttocks", "rectum", "vagina", "anal")),
    (324, has("penis", "circumcision", "penile", "scrot", "testic")),
    (325, has("groin")),
    (330, has("back")),
    (410, has("shoulder", "scapula") | has("proximal") & has("humerus", "humeral")),
    (415, has("clavic")),
    (420, has("upper arm", "humerus", "humeral") & lacks("condyl", "distal", "proximal")),
    (430, has("elbow") | has("distal") & has("humerus", "humeral") | has("condyl")
          | has("radial") & has("head", "neck") | has("ulna") & has("head", "neck") | has("olecranon")
          | has("proximal") & has("radius", "radial", "ulna")),
    (440, (has("forearm", "radius", "ulna", "monteggia") | has_all("lower", "arm") | has("radial"))
          & lacks("distal", "proximal", "upper")),
    (450, has("wrist", "carpal") & lacks("metacarpal") | has("distal") & has("radius", "radial", "ulna")
          | has("scaphoid") | has_all("forearm", "lower")),
    (460, has("hand") & lacks("phalan") | has("metacarpal", "boxer")),
    (470, has("finger", "thumb", "phalan") & (lacks("foot") | lacks("toe"))),
    (510, has("hip") | has_all("neck", "femur") | has("proximal") & has("femur", "femoral") | has_all("fem", "neck")
          | has_all("slipped", "femoral")),
    (520, has("thigh") | lacks("distal", "proximal") & has("femur", "femoral")),
    (530, has("knee", "patella") | has("distal") & has("femur", "femoral") | has("proximal") & has("tibia", "fibula")
          | has_all("tibia", "plateau")),
    (540, has("lower leg", "tibia", "fibula") & lacks("distal", "proximal")),
    (550, has("ankle", "tarsal") | has("distal") & has("tibia", "fibula") | has("tillaux")),
    (570, has("toe", "phalan")),
]

EYE = has("globe", "cornea", "eye", "ocular")
FOREIGN = has("foreign", "fb")

# --- FIXED VALUES: nature of injury codes, with the body part: a code or LOOKUP -----
NATURE_ROWS = [
    (10, has("abrasion") & lacks("globe", "cornea", "eye", "ocular", "canal")
         | (has("bruis", "contusion") | has("hematoma") & lacks("subdural")) & lacks("subungual")
         | has("superficial") & lacks("cut", "laceration", "burn", "swelling") & (lacks("kidney") | lacks("spleen") | lacks("splenic"))
         | has_all("abrasion", "eyelid"), LOOKUP),
    (11, (has("open wound", "laceration") | has_all("minor", "cut") | has_all("nail", "avulsion") | has("circumcision")
          | has("fissure", "epistaxis") | has_all("self", "cut") | has_all("dehiscence", "wound") | has_all("nose", "bleed"))
         & lacks("liver", "splenic") | has_all("tear", "frenulum", "lip"), LOOKUP),
    (12, has("fracture", "fx", "broken") & lacks("tooth", "patholog"), LOOKUP),
    (13, has("dislocation", "subluxation") | has_all("slipped", "femoral"), LOOKUP),
    (14, has("sprain", "strain"), LOOKUP),
    (15, has("nerve", "palsy") & lacks("oedema"), LOOKUP),
    (16, has("blood vessel", "subungual"), LOOKUP),
    (17, has("tendon", "muscle") & has("injury", "rupture", "sever"), LOOKUP),
    (18, has("crush"), LOOKUP),
    (19, has("amputation"), LOOKUP),
    (20, has("burn", "corrosion") & lacks("globe", "cornea", "eye", "ocular"), LOOKUP),
    (21, has("frostbite"), LOOKUP),
    (22, has("bite") & lacks("insect") | has("dog", "squirrel", "racoon", "cat", "human") & lacks("medication", "complication"),
     LOOKUP),
    (23, has("electric"), LOOKUP),
    (24, has("corrosion", "chemical", "injur", "burn", "abrasion", "trauma", "hyphema") & EYE
         | has("eye", "ocular") & has("pain") | has_all("visual", "disturbance")
         | has("conjunctival") & has("haemorrhage", "hemorrhage"), 135),
    (25, has("dental", "tooth", "teeth")
         & has("injury", "fracture", "trauma", "chip", "pain", "implant", "device", "avulsion", "impact"), 135),
    (26, has("kidney", "spleen", "splenic") | has_all("ear", "canal") | has("liver") & has("injury", "abrasion", "laceration")
         | has("perforated tympanic membrane"), LOOKUP),
    (27, (has("pain") & lacks("sickle", "disorder") | has_all("soft", "tissue") & lacks("cyst", "mass")
          | has("swelling") & lacks("eye") | has_all("testicular", "torsion") | has("injury"))
         & lacks("infection", "foreign", "fb"), LOOKUP),
    (31, has("foreign") & EYE, 135),
    (32, (has_all("foreign", "ear") | has("auditory") & lacks("hallucination")) & lacks("earlobe") | has_all("fb", "ear"), 135),
    (33, FOREIGN & has("nose", "nasal", "nostril", "sinus", "nare"), 135),
    (34, FOREIGN & has("respira", "aspiration", "choking", "air", "laryngeal") | has("gagging"), LOOKUP),
    (35, FOREIGN & has("pharyngeal", "intestine", "digestive", "stomach", "ingestion", "colon", "alimentary", "esophag",
                "swallow") | has_all("impaction", "esophagus"), LOOKUP),
    (36, has("foreign") & has("genito-urinary", "bladder", "penis", "urethra", "vagina"), LOOKUP),
    # The body-part test inside this rule never fails, so any foreign body qualifies.
    (37, FOREIGN | has("splinter"), LOOKUP),
    (41, has_all("minor", "head") | has_all("head", "injury") | has_all("head", "trauma"), 135),
    (42, has("concussion"), 135),
    (43, has("intracranial") | has("brain") & lacks("tumor", "tumour", "cancer") | has("subarachnoid")
         | has_all("subdural", "hematoma") | has("intraventricular") & has("haemorrhage", "hemorrhage"), 135),
    (50, has("poison", "toxic", "overdose", "ingestion"), 900),
    (51, has("drown", "immersion"), 900),
    (52, has("asphyxia", "choking"), 900),
    (53, has("overexertion") | has_all("heat", "stress") | has_all("cold", "stress"), 900),
    (70, has_all("no", "injury") & lacks("nose"), 900),
    (71, has("mania", "depressi", "aggressi", "psychosis") | has("tic") & length_is(3)
         | has("stress", "anxiety") & lacks("fracture", "respira") | has("overdose", "hallucination", "anorexia", "poison",
                                                               "intoxication")
         | has("medication", "anger", "night", "behavi", "mental", "disorder", "social", "sleep", "learning", "mood",
             "weight")
         & has("adjustment", "management", "terror", "reaction", "depressed", "concern", "bizarre", "mood", "food",
             "conversion", "eat", "depress", "motor", "tic", "compulsive", "problem", "change", "health",
             "abnormal", "aggressive", "disturbance", "difficult", "loss")
         | has("tic") & has("facial", "simple") | has("suicid", "violent", "ocd") | has_all("drug", "ingestion")
         | has_all("self", "harm") | has("panic", "emotional", "disruptive", "temper") | has_all("food", "refusal")
         | has("banging") | has("behavi") & has("change", "concern") & lacks("neurologic")
         | has("mental", "behavi") & has("disorder"), 900),
    (75, has_all("pulled", "elbow") | has("nursemaid"), 430),
    (76, has("caustic"), LOOKUP),
    (77, has("stab") & lacks("instability") | has("bullet", "penetrat"), LOOKUP),
]
