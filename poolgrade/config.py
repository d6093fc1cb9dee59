"""Families, formulas and thresholds. Formulas are data; the plans compile them to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values: source headings
# canonical name -> headings tried in order
IDENTITY_HEADINGS = {
    "name": ("Jogador",),
    "club": ("Equipe", "Equipa", "Equipa dentro de um período de tempo seleccionado"),
    "position_raw": ("Posição",),
    "nationality": ("Naturalidade", "País de nacionalidade"),
    "foot_raw": ("Pé",),
}
BIO_HEADINGS = {
    "age": ("Idade",),
    "height": ("Altura",),
    "minutes": ("Minutos jogados:",),
}
STAT_HEADINGS = {
    "goals": ("Golos",),
    "assists": ("Assistências",),
    "xa": ("Assistências esperadas",),
    "passes": ("Passes/90",),
    "passes_prog": ("Passes progressivos/90",),
    "passes_long": ("Passes longos/90",),
    "passes_final": ("Passes para terço final/90",),
    "passes_key": ("Passes chave/90",),
    "passes_deep": ("Passes em profundidade/90",),
    "passes_fwd": ("Passes para a frente/90",),
    "passes_smart": ("Passes inteligentes/90",),
    "passes_box": ("Passes para a área de penálti/90",),
    "passes_lat": ("Passes laterais/90",),
    "passes_recv": ("Passes recebidos/90",),
    "passes_long_recv": ("Passes longos recebidos/90",),
    "passes_deep_recv": ("Receção de passes em profundidade/90",),
    "crosses": ("Cruzamentos/90",),
    "passes_pct": ("Passes certos, %",),
    "passes_prog_pct": ("Passes progressivos certos, %",),
    "passes_long_pct": ("Passes longos certos, %",),
    "passes_final_pct": ("Passes certos para terço final, %",),
    "passes_deep_pct": ("Passes em profundidade certos, %",),
    "passes_box_pct": ("Passes precisos para a área de penálti, %",),
    "crosses_pct": ("Cruzamentos certos, %",),
    "duels_def": ("Duelos defensivos/90",),
    "duels_air": ("Duelos aérios/90", "Duelos aéreos/90"),
    "interceptions_raw": ("Interseções/90",),
    "clearances_raw": ("Cortes/90",),
    "def_actions": ("Ações defensivas com êxito/90",),
    "shots_blocked": ("Remates intercetados/90",),
    "fouls": ("Faltas/90",),
    "duels_def_pct": ("Duelos defensivos ganhos, %",),
    "duels_air_pct": ("Duelos aéreos ganhos, %",),
    "duels_off": ("Duelos ofensivos/90",),
    "dribbles": ("Dribles/90",),
    "accels": ("Acelerações/90",),
    "runs_prog": ("Corridas progressivas/90",),
    "shots": ("Remates/90",),
    "touches_box": ("Toques na área/90",),
    "fouls_won": ("Faltas sofridas/90",),
    "goals90": ("Golos/90",),
    "xg90": ("Golos esperados/90",),
    "att_actions": ("Acções atacantes com sucesso/90",),
    "duels_off_pct": ("Duelos ofensivos ganhos, %",),
    "dribbles_pct": ("Dribles com sucesso, %",),
    "shots_pct": ("Remates à baliza, %",),
}
FEED_COUNTERS = ("interception_won", "total_clearance", "outfielder_block", "ball_recovery")

# ---------------------------------------------------------------- fixed values: code lookups
POSITION_OF_CODE = {
    "GK": "Goleiro",
    "RCB": "Zagueiro",
    "LCB": "Zagueiro",
    "CB": "Zagueiro",
    "RB": "Lateral Direito",
    "RWB": "Lateral Direito",
    "LB": "Lateral Esquerdo",
    "LWB": "Lateral Esquerdo",
    "DMF": "Meio-campista",
    "LDMF": "Meio-campista",
    "RDMF": "Meio-campista",
    "LCMF": "Meio-campista",
    "RCMF": "Meio-campista",
    "AMF": "Meia Ofensivo",
    "LAMF": "Meia Ofensivo",
    "RAMF": "Meia Ofensivo",
    "RW": "Extremo Direito",
    "RWF": "Extremo Direito",
    "LW": "Extremo Esquerdo",
    "LWF": "Extremo Esquerdo",
    "CF": "Atacante",
}
FOOT_OF_CODE = {
    "direito": "Destro",
    "esquerdo": "Canhoto",
    "both": "Ambidestro",
    "destro": "Destro",
    "canhoto": "Canhoto",
}
GOALKEEPER = "Goleiro"
SEASON_YEAR = 2026
MIN_POOL_SHARE = 0.20
MIN_STUDY_MINUTES = 400
MIN_ALTERNATE_ROWS = 50
HYBRID = "Híbrido"


@dataclass(frozen=True)
class Index:
    """scale * (sum of weight * block + 2)."""

    label: str
    terms: dict[str, float]
    scale: float = 1.0


@dataclass(frozen=True)
class Family:
    key: str
    label: str
    positions: tuple[str, ...]
    profiles: tuple[str, ...]
    scatter: dict[str, str] = field(default_factory=dict)
    blocks: dict[str, dict[str, float]] = field(default_factory=dict)
    indices: dict[str, Index] = field(default_factory=dict)
    threshold: float = 0.03


# Products used as z-score sources.
PRODUCTS = {
    "crosses_done": ("crosses", "cross_rate"),
    "duels_off_done": ("duels_off_net", "duels_off_rate"),
    "dribbles_done": ("dribbles", "dribble_rate"),
    "shots_done": ("shots", "finish_rate"),
    "duels_def_done": ("duels_def", "duels_def_rate"),
    "duels_air_done": ("duels_air", "duels_air_rate"),
}

# ---------------------------------------------------------------- fixed values: family formulas
CREATION = {"xa": 0.4, "passes_danger": 0.35, "passes_creative": 0.25}
BUILD_UP = {"prog_done": 0.35, "long_done": 0.25, "final_done": 0.4}
DISTRIBUTION = {"passes_done": 0.7, "recv": 0.3}
PRESENCE = {"touches_box": 0.5, "att_touches": 0.5}

FAMILIES = {
    "zagueiros": Family(
        "zagueiros",
        "Zagueiros",
        ("Zagueiro",),
        ("Construtor", "Defensivo", "Híbrido"),
        scatter={
            "intervencoes": "interception_won_p90",
            "confrontos_of": "duels_off_net",
            "construcao": "n_construcao",
            "duelo_ar": "n_duelo_ar",
            "contencao": "n_contencao",
            "ofensividade": "n_conducao",
            "passes_prog": "passes_prog",
            "duelos_def": "duels_def",
        },
        blocks={
            "construcao": {"prog_done": 0.3, "long_done": 0.2, "final_done": 0.5},
            "conducao": {"carry_prog": 0.95, "duels_off_done": 0.05},
            "duelos_def": {"duel_efficiency": 0.6, "duels_def": 0.4},
            "duelo_ar": {"duels_air": 0.45, "duels_air_rate": 0.55},
            "leitura": {"reading_index": 0.25, "interceptions": 0.75},
        },
        indices={
            "construtor": Index("Construtor", {"construcao": 0.8, "conducao": 0.2}),
            "combativo": Index("Combativo", {"duelos_def": 1.0}),
            "ancora": Index("Posicional", {"duelo_ar": 0.5, "leitura": 0.5}, 1.05),
        },
    ),
    "laterais": Family(
        "laterais",
        "Laterais",
        ("Lateral Direito", "Lateral Esquerdo"),
        ("Defensivo", "Construtor", "Ofensivo", "Híbrido"),
        scatter={
            "cruzamentos": "crosses",
            "progressao": "carry_prog",
            "xa": "xa",
            "construcao": "n_construcao",
            "duelos_def": "duels_def",
        },
        blocks={
            "construcao": {"prog_done": 0.5, "final_done": 0.5},
            "duelos_def": {"duel_efficiency": 0.65, "duels_def": 0.35},
            "leitura": {"reading_index": 1.0},
            "presenca": PRESENCE,
            "cruz": {"crosses_done": 1.0},
            "progressao": {"accels": 0.6, "carry_prog": 0.4},
            "conducao": {"dribbles": 0.5, "duels_off_done": 0.5},
        },
        indices={
            "construtor": Index("Construtor", {"construcao": 1.0}, 0.95),
            "defensivo": Index("Defensivo", {"duelos_def": 0.65, "leitura": 0.35}),
            "vertical": Index("Vertical", {"progressao": 0.75, "conducao": 0.125, "presenca": 0.125}),
            "ofensivo": Index("Ofensivo", {"presenca": 0.75, "cruz": 0.25}),
        },
    ),
    "meio-campistas": Family(
        "meio-campistas",
        "Meio-campistas",
        ("Meio-campista",),
        ("Contenção", "Construtor", "Box-to-box", "Ofensivo", "Híbrido"),
        scatter={
            "passes_prog": "passes_prog",
            "xa": "xa",
            "construcao": "n_construcao",
            "progressao": "carry_prog",
        },
        blocks={
            "construcao": {"prog_done": 0.35, "long_done": 0.25, "final_done": 0.3, "box_done": 0.1},
            "distribuicao": DISTRIBUTION,
            "duelos_def": {"duel_efficiency": 0.6, "duels_def": 0.4},
            "leitura": {"reading_index": 0.3, "interceptions": 0.7},
            "duelo_ar": {"duels_air": 0.45, "duels_air_rate": 0.55},
            "finalizacao": {"shots_done": 0.55, "npxg": 0.45},
            "presenca": PRESENCE,
            "criacao": CREATION,
        },
        indices={
            "construtor": Index("Construtor", {"construcao": 0.85, "distribuicao": 0.15}),
            "contencao": Index("Contenção", {"duelos_def": 0.5, "leitura": 0.3, "duelo_ar": 0.2}),
            "boxtobox": Index("Box-to-box", {"finalizacao": 0.3, "duelos_def": 0.4, "presenca": 0.5}),
            "ofensivo": Index("Ofensivo", {"finalizacao": 0.25, "criacao": 0.5, "presenca": 0.25}),
        },
    ),
    "extremos": Family(
        "extremos",
        "Extremos",
        ("Extremo Direito", "Extremo Esquerdo"),
        ("Criador", "Meia Ponta", "Vertical", "Híbrido"),
        scatter={
            "dribles": "dribbles",
            "xa": "xa",
            "progressao": "carry_prog",
            "finalizacao": "shots",
        },
        blocks={
            "conducao": {"dribbles_done": 0.7, "duels_off_done": 0.3},
            "cruz": {"crosses_done": 1.0},
            "construcao": BUILD_UP,
            "distribuicao": DISTRIBUTION,
            "progressao": {"accels": 0.6, "carry_prog": 0.4},
            "desmarque": {"long_recv": 0.7, "touches_box": 0.3},
        },
        indices={
            "criador": Index("Criador", {"conducao": 1.0}, 1.025),
            "meia_ponta": Index("Meia Ponta", {"construcao": 0.35, "distribuicao": 0.35, "cruz": 0.3}),
            "vertical": Index("Vertical", {"progressao": 0.7, "desmarque": 0.3}),
        },
    ),
    "meias-ofensivos": Family(
        "meias-ofensivos",
        "Meias Ofensivos",
        ("Meia Ofensivo",),
        ("Armador", "Finalizador", "Híbrido"),
        scatter={
            "passes_chave": "passes_key",
            "xa": "xa",
            "progressao": "carry_prog",
            "gols": "goals",
        },
        blocks={
            "construcao": BUILD_UP,
            "criacao": CREATION,
            "cruz": {"crosses_done": 1.0},
            "distribuicao": DISTRIBUTION,
            "finalizacao": {"shots": 0.5, "goals_over_xg": 0.5},
            "conducao": {"dribbles_done": 0.6, "carry_prog": 0.4},
            "progressao": {"carry_prog": 0.6, "accels": 0.4},
        },
        indices={
            "armador": Index(
                "Armador", {"construcao": 0.15, "criacao": 0.4, "cruz": 0.3, "distribuicao": 0.15}, 1.075
            ),
            "finalizador": Index("Finalizador", {"finalizacao": 0.5, "conducao": 0.25, "progressao": 0.25}),
        },
        threshold=0.05,
    ),
    "atacantes": Family(
        "atacantes",
        "Atacantes",
        ("Atacante",),
        ("Finalizador", "Alvo", "Móvel", "Híbrido"),
        scatter={
            "gols": "goals",
            "finalizacao": "shots",
            "toques_area": "touches_box",
            "progressao": "carry_prog",
        },
        blocks={
            "finalizacao": {"shots_done": 0.7, "npxg": 0.3},
            "efetividade": {"goals_per_touch": 0.5, "goals_over_xg": 0.5},
            "duelo_ar": {"duels_air": 0.7, "duels_air_rate": 0.3},
            "criacao": CREATION,
            "conducao": {"dribbles": 0.5, "carry_prog": 0.5},
            "progressao": {"carry_prog": 0.6, "att_touches": 0.4},
        },
        indices={
            "finalizador": Index("Finalizador", {"finalizacao": 0.77, "efetividade": 0.33, "duelo_ar": -0.35}),
            "alvo": Index("Alvo", {"duelo_ar": 0.7, "efetividade": 0.3}),
            "movel": Index("Móvel", {"criacao": 0.5, "conducao": 0.3, "progressao": 0.2}),
        },
    ),
}
GENERIC_FAMILIES = ("meio-campistas", "extremos", "meias-ofensivos", "atacantes")
POSITION_FAMILY = {p: f.key for f in FAMILIES.values() for p in f.positions}

# Labels of the scatter metrics, published with the site meta.
SCATTER_LABELS = {
    "intervencoes": "Intervenções",
    "confrontos_of": "Confrontos Ofensivos",
    "construcao": "Construção",
    "duelo_ar": "Duelo Aéreo",
    "contencao": "Contenção",
    "ofensividade": "Ofensividade",
    "passes_prog": "Passes Progressivos",
    "duelos_def": "Duelos Defensivos",
    "cruzamentos": "Cruzamentos",
    "progressao": "Progressão",
    "xa": "xA",
    "dribles": "Dribles",
    "finalizacao": "Finalizações",
    "passes_chave": "Passes Chave",
    "gols": "Gols",
    "toques_area": "Toques na Área",
}

# Rows of the profile comparison per family: (key, label).
PROFILE_ROWS = {
    "zagueiros": (("perfil", "Nota do Perfil"), ("construcao", "Construção"), ("defesa", "Defesa")),
    "laterais": (
        ("defensivo", "Defensivo"),
        ("construtor", "Construtor"),
        ("vertical", "Vertical"),
        ("ofensivo", "Ofensivo"),
    ),
    "meio-campistas": (
        ("contencao", "Contenção"),
        ("construtor", "Construtor"),
        ("boxtobox", "Box-to-box"),
        ("ofensivo", "Ofensivo"),
    ),
    "extremos": (("criador", "Criador"), ("meia_ponta", "Meia Ponta"), ("vertical", "Vertical")),
    "meias-ofensivos": (("armador", "Armador"), ("finalizador", "Finalizador")),
    "atacantes": (("finalizador", "Finalizador"), ("alvo", "Alvo"), ("movel", "Móvel")),
}
TENDENCIES = ("construcao", "ofensividade", "def1v1", "contencao", "duelo_aereo")

# ---------------------------------------------------------------- fixed values: centre-backs
AREA, BUILDER, COMBAT = "Defensor de Área", "Construtor", "Combativo"
CB_AXES = {
    AREA: ("total_clearance_p90", "duels_air", "outfielder_block_p90"),
    BUILDER: ("passes_final", "share_prog", "carry_prog"),
    COMBAT: ("duels_def", "interception_won_p90", "style_ratio"),
}
CB_AXES_STUDY_BUILDER = ("passes_final", "passes", "share_prog", "carry_prog")
BUILDER_MIN_Z = 0.25
STRONG_Z = 0.30
DUEL_TIE_BREAK_Z = 1.5
ANCHOR_BADGE = ("Construtor Âncora", "Âncora")
NATIVE_BADGE = ("Construtor Nato", "Nato")

SCORE_AXES = ("duelos_def", "duelos_ar", "passes_prog", "passes_long", "eficiencia_def")
ARCHETYPE_WEIGHTS = {
    "construtor": {
        "passes_prog": 0.35,
        "passes_long": 0.35,
        "duelos_def": 0.10,
        "duelos_ar": 0.10,
        "eficiencia_def": 0.10,
    },
    "combativo": {
        "passes_prog": 0.10,
        "passes_long": 0.10,
        "duelos_def": 0.50,
        "duelos_ar": 0.10,
        "eficiencia_def": 0.20,
    },
    "defensor_area": {
        "passes_prog": 0.10,
        "passes_long": 0.10,
        "duelos_def": 0.20,
        "duelos_ar": 0.30,
        "eficiencia_def": 0.30,
    },
}
WEAK_AXIS_GAP = 10.0
AXIS_MU = 50.0
SHRINK_EXPONENT = 0.65
BALANCE_SD = 12.0
BALANCE_BONUS = 3.0
NOTE_MU, NOTE_SCALE, NOTE_TAU = 6.5, 1.85, 2.5
CORE_SHARE = 0.50
SYMMETRY_SPREAD = 15.0

BUILD_WEIGHTS = {"prog": 51.5625, "final": 14.0625, "long": 9.375, "carry": 15.0, "duel": 10.0}
DEFENCE_WEIGHTS = {"duel_def": 35.0, "inter": 20.0, "clear": 5.0, "block": 5.0, "duel_air": 35.0}
RATING_MU = 7.25
PROFILE_GAP = 1.0
CONFIDENCE_CUTOFF, CONFIDENCE_FLOOR, CONFIDENCE_EXPONENT = 75.0, 0.70, 0.25
SAMPLE_LOW, SAMPLE_HIGH, SAMPLE_EXPONENT = 6.5, 10.0, 0.75
SAMPLE_MINUTES_EXPONENT = 0.38
COST_OVERLAP = 0.45
BADGE_BONUS = {"gold": 0.20, "silver": 0.15, "bronze": 0.10}

# ---------------------------------------------------------------- fixed values: full-backs
FB_AXES = {
    "Defensivo": ("duels_def", "total_clearance_p90", "interception_won_p90", "duels_air"),
    "Construtor": ("passes_prog", "passes_final", "recv", "passes_long"),
    "Ofensivo": ("touches_box", "crosses", "accels", "runs_prog", "dribbles", "duels_off", "att_actions"),
}
FB_PAIR_BADGES = {
    ("Construtor", "Defensivo"): ("Lateral Base", "Base"),
    ("Defensivo", "Ofensivo"): ("Lateral Moderno", "Moderno"),
    ("Construtor", "Ofensivo"): ("Lateral Projetivo", "Projetivo"),
}
FB_TRIPLE_BADGE = ("Lateral Completo", "Completo")


# ---------------------------------------------------------------- fixed values: regression studies
@dataclass(frozen=True)
class StudyMetric:
    key: str
    volume: str
    efficiency: str
    impact: str
    full_confidence: float
    cap: float
    negate: bool = False


STUDY_METRICS = (
    StudyMetric("duelos_def", "duels_def", "duels_def_pct", "duels_def_impact", 80.0, 5.0),
    StudyMetric("duelos_ar", "duels_air", "duels_air_pct", "duels_air_impact", 50.0, 5.0),
    StudyMetric("passes_prog", "passes_prog", "passes_prog_pct", "passes_prog_impact", 120.0, 5.0),
    StudyMetric("passes_long", "passes_long", "passes_long_pct", "passes_long_impact", 100.0, 5.0),
    StudyMetric("eficiencia_def", "acoes_def", "custo_def", "inter_clear_p90", 60.0, 0.10, True),
)

# ---------------------------------------------------------------- fixed values: matching
FEED_CLUB_ALIASES = {
    "athletico paranaense": ("athletico",),
    "red bull bragantino": ("bragantino",),
    "atletico mineiro": ("atletico mineiro",),
    "vasco da gama": ("vasco",),
    "internacional": ("internacional",),
    "coritiba": ("coritiba",),
    "sao paulo": ("sao paulo",),
    "fluminense": ("fluminense",),
}
ROSTER_CLUB_ALIASES = {
    "athletico paranaense": ("athletico", "athletico paranaense", "cap"),
    "atletico mineiro": ("atlético mineiro", "atletico mineiro", "atl mineiro"),
    "vasco da gama": ("vasco", "cr vasco"),
    "red bull bragantino": ("bragantino", "rb bragantino", "red bull bragantino"),
    "sao paulo": ("são paulo", "spfc"),
    "internacional": ("inter", "sport club internacional"),
    "gremio": ("grêmio",),
    "cruzeiro": ("cruzeiro esporte clube",),
    "fluminense": ("fluminense football club",),
    "corinthians": ("sc corinthians", "corinthians"),
    "palmeiras": ("se palmeiras", "palmeiras"),
    "flamengo": ("cr flamengo", "flamengo"),
    "santos": ("santos fc",),
    "bahia": ("ec bahia", "bahia"),
    "fortaleza": ("fortaleza ec",),
    "ceara": ("ceará", "ceara sc"),
    "chapecoense": ("chapecoense af",),
    "mirassol": ("mirassol fc",),
    "remo": ("clube do remo",),
}
DIRECTORY_OVERRIDES = {
    "botafogo": "botafogo fr",
    "gremio": "gremio fbpa",
    "remo": "clube do remo",
    "vitoria": "ec vitoria",
    "nautico": "nautico",
}
DIRECTORY_SKIP = ("juventus",)
