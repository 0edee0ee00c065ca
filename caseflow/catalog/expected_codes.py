"""Hand-worked expected codes for the fixture diagnoses (oracle side only).

Worked out by reading the coding rules one by one for each text, not by running
them; (body part alone, nature, body part paired with the nature).
"""

EXPECTED = {
    "Fracture of metatarsal bone": (560, 12, 560),
    "Minor head injury": (110, 27, 110),
    "Laceration of eyelid": (120, 11, 120),
    "Abrasion of forearm": (440, 10, 440),
    "Sprain of ankle": (550, 14, 550),
    "Closed fracture of distal radius": (450, 12, 450),
    "Concussion": (None, 42, 135),
    "Foreign body in ear": (120, 32, 135),
    "Foreign body in nose": (120, 33, 135),
    "Dog bite of hand": (460, 22, 460),
    "Burn of hand": (460, 20, 460),
    "Subungual hematoma of finger": (470, 16, 470),
    "Facial fracture": (120, 12, 120),
    "Pulled elbow": (430, 75, 430),
    "Overdose": (None, 50, 900),
    "Depression": (None, 71, 900),
    "Dislocation of shoulder": (410, 13, 410),
    "Contusion of knee": (530, 10, 530),
    "Fracture of clavicle": (415, 12, 415),
    "Crush injury of toe": (570, 18, 570),
    "Corneal abrasion of eye": (None, 24, 135),
    "Dental injury": (None, 25, 135),
    "Splinter in skin": (None, 37, None),
    "Near drowning": (120, 51, 900),
    "Choking episode": (None, 52, 900),
    "Abdominal pain": (321, 27, 321),
    "Viral infection": (None, None, None),
    "No injury, infection ruled out": (None, 70, 900),
    "Stab wound to chest": (310, 77, 310),
    "Fracture of tibia and fibula": (540, 12, 540),
    "Monteggia fracture of forearm": (440, 12, 440),
    "Nursemaid elbow": (430, 75, 430),
    "Head trauma": (110, 41, 135),
    "Subdural hematoma": (None, 43, 135),
    "Fracture of skull": (110, 12, 110),
    "Open wound of scalp": (110, 11, 110),
    "Strain of lower back": (322, 14, 322),
    "Amputation of thumb": (470, 19, 470),
    "Electric shock": (None, 23, None),
    "Injury of spleen": (321, 26, 321),
}


def values_sql() -> str:
    def v(x):
        return "NULL" if x is None else str(x)
    rows = ", ".join("('{}', {}, {}, {})".format(k.replace("'", "''"), v(a), v(b), v(c))
                     for k, (a, b, c) in EXPECTED.items())
    return ("SELECT diagnosis, CAST(bp AS INTEGER) AS bp, CAST(no AS INTEGER) AS no, CAST(nbp AS INTEGER) AS nbp "
            f"FROM (VALUES {rows}) t(diagnosis, bp, no, nbp)")
