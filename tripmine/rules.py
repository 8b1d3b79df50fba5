"""Rule tables: the fixed values every operator is parameterised with.

Everything in this module is a fixed value that has to be equal to the values
users run today, otherwise results change: keyword lists, domains, airline
codes, patterns, scores and thresholds. Order matters where a comment says so.

Patterns are Java regular expressions. The prefix flags mean:
``U`` Unicode classes for ``\\s \\d \\w \\b``, ``d`` only ``\\n`` ends a line
for ``.`` and ``$``, ``i`` ignore case.
"""

from __future__ import annotations

# --- airline detection: the first rule that applies wins ---------------------

UNKNOWN_AIRLINE = "Unknown Airline"
VIETJET = "VietJet Air"

AIRLINE_KEYWORDS: list[tuple[str, list[str]]] = [
    ("VietJet Air", ["vietjet", "vjet air"]),
    ("AirAsia", ["airasia", "air asia"]),
    ("Vietnam Airlines", ["vietnam airlines", "vietnamairlines"]),
    ("Cebu Pacific", ["cebu pacific", "cebu pacific air"]),
    ("LATAM Airlines", ["latam airlines", "latam"]),
    ("Delta Air Lines", ["delta air lines", "delta airlines"]),
    ("United Airlines", ["united airlines"]),
    ("American Airlines", ["american airlines"]),
    ("Southwest Airlines", ["southwest airlines"]),
    ("JetBlue", ["jetblue", "jet blue"]),
    ("Avianca", ["avianca"]),
    ("Iberia", ["iberia"]),
    ("TAP Air Portugal", ["tap air portugal", "tap portugal"]),
    ("Ryanair", ["ryanair"]),
    ("easyJet", ["easyjet", "easy jet"]),
    ("Copa Airlines", ["copa airlines", "copa air"]),
    ("AeroMexico", ["aeromexico"]),
    ("Aerolineas Argentinas", ["aerolineas argentinas"]),
    ("Azul", ["azul linhas", "azul linhas aereas"]),
    ("GOL", ["gol linhas", "gol linhas aereas"]),
]

AIRLINE_DOMAINS: list[tuple[str, str]] = [
    ("vietjetair.com", "VietJet Air"),
    ("airasia.com", "AirAsia"),
    ("vietnamairlines.com", "Vietnam Airlines"),
    ("cebu-pacific.com", "Cebu Pacific"),
    ("cebupacific.com", "Cebu Pacific"),
    ("mycebupacific.com", "Cebu Pacific"),
    ("latam.com", "LATAM Airlines"),
    ("delta.com", "Delta Air Lines"),
    ("o.delta.com", "Delta Air Lines"),
    ("united.com", "United Airlines"),
    ("aa.com", "American Airlines"),
    ("southwest.com", "Southwest Airlines"),
    ("jetblue.com", "JetBlue"),
    ("avianca.com", "Avianca"),
    ("iberia.com", "Iberia"),
    ("tap.pt", "TAP Air Portugal"),
    ("ryanair.com", "Ryanair"),
    ("easyjet.com", "easyJet"),
    ("copaair.com", "Copa Airlines"),
    ("aeromexico.com", "AeroMexico"),
    ("aerolineas.com.ar", "Aerolineas Argentinas"),
    ("voeazul.com.br", "Azul"),
    ("azul.com.br", "Azul"),
    ("voegol.com.br", "GOL"),
    ("gol.com.br", "GOL"),
]

# --- potential-flight test and booking gate ----------------------------------

POTENTIAL_EXCLUSIONS = [
    "airbnb", "booking.com", "hotels.com", "expedia",
    "reservation at", "hotel", "apartment",
]
POTENTIAL_DOMAINS = [
    "airasia.com", "vietnamairlines.com", "united.com", "delta.com",
    "aa.com", "emirates.com", "klm.com", "lufthansa.com",
]
POTENTIAL_INDICATORS = [
    "flight confirmation", "booking confirmation", "e-ticket",
    "check-in", "boarding pass", "flight itinerary",
    "travel confirmation", "flight receipt",
]
POTENTIAL_SUBJECT_NUMBER = r"(?U)\b[A-Z]{2}\d{3,4}\b"

BOOKING_AIRLINE_CODES = [
    "CX", "SQ", "MH", "TR", "3K", "5J", "PR", "AK", "FD", "VJ", "QH", "VN", "BL",
]
BOOKING_CODE = r"(?<![A-Z0-9])([A-Z0-9]{6})(?![A-Z0-9])"
BOOKING_NUMBER = r"(?U)(?<![A-Z0-9])([A-Z]{2}\d{3,4})(?![A-Z0-9])"
BOOKING_CONTEXT_WORD = "flight"
BOOKING_CONTEXT_DISTANCE = 50

SCORE_CODE = 0.4
SCORE_NUMBER = 0.4
SCORE_CONTEXT = 0.2
BOOKING_MIN_CONFIDENCE = 0.6
ITINERARY_SKIP_THRESHOLD = 0.6

# --- VietJet mail: per field, the first pattern that matches wins -------------

VIETJET_CODE = [
    r"(?iU)Reservation\s*#?\s*([A-Z0-9]+)",
    r"(?iU)Booking\s*(?:number|#)?\s*([A-Z0-9]+)",
]
VIETJET_NUMBER = [
    r"(?U)Flight\s*(?:No\.|Number)?\s*([A-Z]{2}\s*\d{3,4})",
    r"(?U)([A-Z]{2}\s*\d{3,4})",
]
VIETJET_AIRPORTS = [
    r"(?iU)(?:From|Departure):\s*([A-Z]{3})\s+(?:To|Arrival):\s*([A-Z]{3})",
    r"(?iU)([A-Z]{3})\s*(?:to|->|-)\s*([A-Z]{3})",
    r"(?iU)([A-Z]{3})[^A-Z]{1,20}([A-Z]{3})",
]
VIETJET_DATE = [
    r"(?U)(?:Date|Departure):\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
    r"(?U)(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
    r"(?U)(\d{2}/\d{2}/\d{4})",
]

# --- generic mail in four languages: same rule --------------------------------

IATA = r"(?<![A-Z])(?-i:([A-Z]{3}))(?![A-Z])"

GENERIC_NUMBER = [
    r"(?iU)(?:flight|flight\s+number|voo|n[o0]?\s*de\s*voo|numero\s*do\s*voo|"
    r"vuelo|numero\s*de\s*vuelo|n[o0]\s*de\s*vuelo)\s*[:#]?\s*"
    r"((?-i:[A-Z0-9]{2,3})\s*\d{1,4})",
    r"(?iU)(?:flight|voo|vuelo)\s*[:#]?\s*((?-i:[A-Z0-9]{2,3})\s*\d{1,4})",
    r"(?iU)\b((?-i:[A-Z0-9]{2,3})\s*\d{1,4})\b\s*(?:to|->|-)",
]
# Every match of the first two number patterns holds one of these words.
GENERIC_NUMBER_WORDS = ["flight", "voo", "vuelo"]
GENERIC_AIRPORTS = [
    r"(?iU)(?:from|de|desde|origem|origen|departure|salida)\s*[:\-]?\s*"
    rf"(?:[^\n\r]{{0,50}}?)\(?\s*{IATA}\s*\)?\s*"
    r"(?:to|para|ate|a|hasta|destino|arrival|chegada|llegada)\s*[:\-]?\s*"
    rf"(?:[^\n\r]{{0,50}}?)\(?\s*{IATA}\s*\)?",
    rf"(?iU)\(?\s*{IATA}\s*\)?\s*(?:to|para|a|hasta|->|-)\s*\(?\s*{IATA}\s*\)?",
    rf"(?iU){IATA}\s*(?:to|->|-)\s*{IATA}",
]
GENERIC_CODE = [
    r"(?iU)(?:confirmation|confirmacion|confirmacao|"
    r"booking|reserva|reservacion|reference|referencia|"
    r"pnr|reservation|localizador|codigo\s+de\s+reserva|"
    r"codigo\s+de\s+confirmacion)\s*(?:code|number|#)?\s*[:# ]\s*([A-Z0-9]{5,8})",
    r"(?iU)#\s*([A-Z0-9]{5,8})",
]

# --- second-generation tracker -------------------------------------------------

TRACKER_CODE = (
    r"(?iU)(?:(?:confirmation|booking|reference|pnr|reservation)"
    r"(?:\s+(?:code|number|#|no|id))?\s*[:# ]*)([A-Z0-9]{6})(?!\w)"
)
TRACKER_NUMBER = r"(?U)(?:flight(?:\s+(?:number|#|no))?\s*[:# ]*)?([A-Z]{2})\s*(\d{1,4})(?!\d)"
TRACKER_CODE_WORDS = ["confirmation", "booking", "reference", "pnr", "reservation"]
TRACKER_CONTEXT = r"(?iU)(?:flight|boarding|departure|arrival)"
TRACKER_CONTEXT_WORDS = ["flight", "boarding", "departure", "arrival"]
TRACKER_CONTEXT_STEP = 0.1
TRACKER_CONTEXT_MAX = 0.2
TRACKER_MIN_CONFIDENCE = 0.4

# --- search rules ----------------------------------------------------------------

SEARCH_STRICT_SUBJECT = ["flight", "booking", "itinerary", "e-ticket", "reservation", "travel"]
SEARCH_STRICT_SENDER = ["@vietjetair.com", "@trip.com", "@booking.com", "@cebuair.com"]
SEARCH_V2_SENDER = ["airlines", "booking", "travel"]
SEARCH_V2_SUBJECT = ["flight confirmation", "itinerary", "e-ticket"]

# --- message defaults --------------------------------------------------------------

NO_SUBJECT = "No Subject"
UNKNOWN_SENDER = "Unknown Sender"

# --- request texts and cost estimate -------------------------------------------------

COST_PROMPT_HEAD = "You are given an email. Extract flight details if present.\n\n"
EXTRACTION_PROMPT_HEAD = (
    "Extract flight details from the email. "
    "If a field is not present, return null. "
    "Prefer IATA airport codes and ISO 8601 date/time if possible.\n\n"
)
CLASSIFICATION_PROMPT_HEAD = (
    "Decide if this email is a travel itinerary or contains actionable travel reservation info. "
    "Return true for flights, boarding passes, check-in notices, ticketing, or reservations with "
    "dates, cities, airports, or booking codes. Return false for promos, surveys, blogs, loyalty "
    "marketing, or unrelated travel content.\n\n"
)
PROMPT_LABELS = ("Subject: ", "From: ", "Date: ", "Body:")
CHARS_PER_TOKEN = 4
OUTPUT_TOKENS_EXTRACTION = 300
OUTPUT_TOKENS_CLASSIFICATION = 60
PROMPT_OVERHEAD_TOKENS = 200
