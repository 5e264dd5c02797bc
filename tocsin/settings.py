"""Limits per type, thresholds and term lists.

Every job takes these as parameters; the constants below are only the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: limits per type (max speed km/h, max distance km, lifetime min) ---------------
PROFILES = {
    "FPV": (160.0, 40.0, 30.0),
    "FpvFiberOptic": (160.0, 50.0, 40.0),
    "StrikeDrone": (150.0, 100.0, 60.0),
    "Recon": (80.0, 25.0, 120.0),
    "RearDrone": (200.0, 150.0, 60.0),
    "Rocket": (500.0, 100.0, 15.0),
}
DEFAULT_PROFILE = (160.0, 40.0, 30.0)
DEFAULT_EXPIRY_MIN = 120.0


@dataclass(frozen=True)
class Limits:
    """Scalar settings of the jobs."""

    profiles: dict = field(default_factory=lambda: dict(PROFILES))
    default_profile: tuple = DEFAULT_PROFILE
    default_expiry_min: float = DEFAULT_EXPIRY_MIN
    watch_boost: float = 0.2
    located_boost: float = 0.1
    attack_window_min: float = 90.0
    alert_confidence: float = 0.6
    utc_offset_hours: int = 3
    recon_radius_km: float = 7.0
    forecast_max_km: float = 50.0
    uncertainty: float = 0.2
    edge_min_count: int = 3

    def profile(self, type_: str | None) -> tuple:
        return self.profiles.get(type_, self.default_profile)

    def expiry_min(self, type_: str | None) -> float:
        p = self.profiles.get(type_)
        return p[2] if p else self.default_expiry_min

    @property
    def longest_expiry_min(self) -> float:
        return max([self.default_expiry_min, *(p[2] for p in self.profiles.values())])


LIMITS = Limits()

# --- fixed values: ordered term -> type list; None leaves the type unknown and still stops --------
FIBRE_TERMS = ["оптоволокн", "оптик", "волокн", "fiberoptic", "на проводе"]
TYPE_TERMS = [
    ("фпв", "FPV"), ("fpv", "FPV"), ("хорнет", "Hornet"), ("дартс", "Dart"), ("шарк", "Shark"),
    ("лелека", "Leleka"), ("разведчик", "Recon"), ("ударный", "StrikeDrone"), ("ракет", "Rocket"),
    ("рсзо", "Rocket"), ("уаб", "Rocket"), ("авиация", None), ("пуск", "Rocket"), ("бпла", "Drone"),
    ("шторм", "Rocket"), ("stormshadow", "Rocket"), ("scalp", "Rocket"), ("баба яга", None),
    ("лютый", None), ("фурия", None), ("обстрел", "Rocket"), ("артобстрел", "Rocket"),
    ("прилет", "Rocket"), ("прилетел", None), ("взрыв", "Rocket"), ("взрывы", None),
    ("ракетный удар", "Rocket"), ("ракетная опасность", "Rocket"),
]
DRONE_TYPES = ["FPV", "Hornet", "Dart", "Shark", "Leleka", "Recon", "StrikeDrone", "Drone"]
WEATHER_TERMS = ["ветер", "туман", "порывы"]

# --- fixed values: second, place-less all-clear classifier -----------------------------------------
CLEAR_TYPE_TERMS = [
    ("фпв", "FPV"), ("fpv", "FPV"), ("бпла", "Drone"), ("дрон", "Drone"), ("ударному", "Drone"),
    ("ракет", "Rocket"), ("рсзо", "Rocket"), ("хорнет", "StrikeDrone"), ("дартс", "StrikeDrone"),
    ("шарк", "Recon"), ("разведчик", "Recon"), ("разведовательн", "Recon"),
]

# --- fixed values: status and flag terms -------------------------------------------------------------
CLEAR_TERMS = [("отбой", False), ("отмен", False), ("уничтожен", True), ("сбит", True)]
WATCH_TERMS = ["режим внимания", "режим внимание", "внимание, режим"]
FLAG_TERMS = [
    ("TakeCover", ["в укрытие", "укрытие"]),
    ("StopMovement", ["стоп движение", "остановить движение"]),
    ("Confirmed", ["подтвержден", "подтверждена"]),
]

# --- fixed values: priority classes, first match wins (lists are any-of; tuples are all-of) --------
PRIORITY_TERMS = [
    (["ракет", "пуск", "уаб"], 0),
    (["хорнет", "дартс", "ударный"], 1),
    (["шарк", "лелека", "разведчик"], 2),
    (["фпв", "fpv"], 3),
    (["отбой", ("внимание", "режим")], 4),
]
#: the notification variant is stricter in its second class
PRIORITY_TERMS_NOTIFICATION = [
    (["хорнет", "дартс", "ударный бпла"], 1) if rank == 1 else (terms, rank)
    for terms, rank in PRIORITY_TERMS
]
LOWEST_PRIORITY = 5

# --- fixed values: administrative units ---------------------------------------------------------------
ADMIN_TERMS = ["район", "округ", "область"]
ADMIN_SHORT = "МО"

# --- fixed values: stop words ---------------------------------------------------------------------------
STOP_WORDS = [
    "канал", "оповещения", "чистое", "небо", "резервный", "мах", "подпишись",
    "внимание", "вниманию", "режим", "фпв", "fpv", "бпла", "ударный", "дрон",
]
STOP_WORDS_TFIDF = STOP_WORDS + ["отбой", "опасности", "всем", "покинуть", "автомобили"]

# --- fixed values: word endings by group; an ending is cut only if two letters remain -------------------
ENDINGS = """
ившись ывшись вшись ивши ывши вши ив ыв в
ся сь
ее ие ые ое ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею
ем нн вш ющ щ евш овавш ивш ывш овав евав ова ева ив
ела ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ить ыть ешь ете йте
иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий й ия ья я а е ы ь и у ю о
ейше ейш
ост ость
""".split()

# --- fixed values: channel boilerplate removed before duplicate comparison ------------------------------
BOILERPLATE = [
    r"канал\s+в\s+max\s*-?",
    r'канал\s+оповещения\s*"[^"]*"',
    r"резервный\s+канал\s+мах-подпишись",
]
