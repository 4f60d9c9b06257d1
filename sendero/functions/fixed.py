"""Fixed values whose exact text the results depend on.

These are the literal sentence templates, defaults, markers, messages, labels
and model prompt templates of the recommender; they are data, stated once here
in natural order and used by both the Spark code and the oracle SQL.
Placeholders are written ``{name}``; ``{{`` / ``}}`` are literal braces.
"""

# --- fixed values: narrative templates --------------------------------------
EXPLICIT_TEMPLATE = (
    "Usuario {genero} de {edad} años, nacionalidad {nacionalidad}, "
    "idioma principal {idioma_principal}, ocupación {ocupacion}. "
    "Tipo de viajero: {tipo_viajero} con presupuesto {presupuesto_viaje}. "
    "Suele viajar en {compania_viaje}, estadía promedio {duracion_estadia_promedio} días, "
    "en época {epoca_preferida}. Destinos frecuentes: {destino_frecuente}, "
    "alojamiento preferido: {alojamiento_preferido}, nivel de actividad: {nivel_actividad}. "
    "Intereses principales: {intereses}. Actividades preferidas: {actividades}."
)
PLACE_TEMPLATE_CATALOGUE = "Lugar turístico: {nombre_sitio}. Categoría: {categoria_sitio}. Ubicación: {ubicacion}."
PLACE_TEMPLATE_INDEX = "Lugar: {nombre_sitio}. Categoría: {categoria_sitio}. Ubicación: {ubicacion}."
PLACE_TEMPLATE_QUERY = "Nombre: {nombre_sitio}. Categoría: {categoria_sitio}. Ubicación: {ubicacion}."

HISTORY_TEMPLATE = "Historial del usuario: interactúa con categorías {cats} en {lugares}."
BOOKED_TEMPLATE = "Reservó en: {items}."
FAVOURITE_TEMPLATE = "Marcó como favoritos: {items}."
TOP_RATED_TEMPLATE = "Valoró positivamente: {items}."
DEFAULT_CATEGORIES = "diversas"
DEFAULT_LOCATIONS = "varias"

RECENT_BEHAVIOUR_MARKER = "\n[COMPORTAMIENTO RECIENTE] "
COLD_START_MARKER = "[COLD START - PERFIL DECLARADO] "

# --- fixed values: interaction kinds, thresholds, defaults -------------------
BOOKING_KIND = "reserva"
FAVOURITE_KIND = "favorito"
TOP_RATED_MIN = 4.0
TOP_CATEGORIES = 3
TOP_LOCATIONS = 2
FIRST_ITEMS = 3
DEFAULT_NAME = "Sin Nombre"
DEFAULT_FIELD = "N/A"

# --- fixed values: outcome messages and labels -------------------------------
NO_PLACE_CANDIDATES = "No se encontraron nuevos candidatos disponibles."
NO_USER_CANDIDATES = "No se encontraron usuarios potenciales nuevos."
AFFINITY_LEVELS = ["Muy Alta", "Alta", "Exploratoria"]
USER_LABEL_SEPARATOR = " - "
PLACE_LABEL_SEPARATOR = " | ID: "

# --- fixed values: defaults of the two pipelines -------------------------------
DIRECT_TOP_K = 6
INVERSE_TOP_K = 10
TOP_N = 3
DEFAULT_GENERATOR = "qwen2.5:7b"
GENERATOR_CHOICES = [
    "qwen2.5:7b",
    "llama3.2:3b",
    "gemma2:2b",
    "qwen2.5-coder:7b-instruct-q4_K_M",
    "gemma4:e4b",
]
GENERATION_OPTIONS = {"temperature": 0.1}
TEMPLATE_VARIABLES = ["top_n", "user_context", "candidates_json"]

# --- fixed values: model prompt templates ---------------------------------------
INVERSE_PROMPT_TEMPLATE = """Eres un consultor experto en marketing turístico y segmentación de audiencias.
Dado el siguiente sitio o recurso turístico y un grupo de usuarios candidatos recuperados, selecciona los mejores {top_n} usuarios objetivo (target audience) que tengan la mayor afinidad con la propuesta de valor del lugar.

[INFORMACIÓN DEL SITIO TURÍSTICO]
{place_context}

[USUARIOS CANDIDATOS]
{candidates_json}

INSTRUCCIONES:
1. Analiza el presupuesto, estilo de viaje, historial e intereses de cada usuario frente a lo que ofrece el sitio.
2. Selecciona exactamente los {top_n} usuarios más idóneos.
3. Explica de forma concisa y causal por qué este sitio encaja con las motivaciones de ese usuario.

Responde ÚNICAMENTE con un JSON válido con la siguiente estructura:
{{
  "usuarios_recomendados": [
    {{
      "id_usuario": "id",
      "nombre": "nombre",
      "tipo_viajero": "tipo",
      "justificacion_target": "Por qué este usuario es el cliente objetivo ideal para este lugar"
    }}
  ]
}}"""

DIRECT_PROMPT_TEMPLATE = """Eres un recomendador turístico experto, riguroso y objetivo.
Analiza el perfil y contexto del usuario frente a los lugares candidatos recuperados.

REGLAS ESTRICTAS:
1. Basar tus justificaciones ÚNICAMENTE en los intereses, presupuesto, compañía y actividades del perfil del usuario.
2. NO inventes preferencias geográficas (países/ciudades) no declaradas. Si recomiendas un lugar en otra región, justifícalo por el TIPO de actividad o categoría, reconociendo con transparencia que es un nuevo destino.
3. Selecciona los mejores {top_n} lugares y asigna un nivel de afinidad cualitativo ("Muy Alta", "Alta", "Exploratoria").

[CONTEXTO DEL USUARIO]
{user_context}

[LUGARES CANDIDATOS RECUPERADOS]
{candidates_json}

Devuelve ÚNICAMENTE un JSON con esta estructura exacta:
{{
  "recomendaciones": [
    {{
      "nombre_sitio": "Nombre del sitio",
      "categoria_sitio": "Categoría",
      "ubicacion": "Ciudad, País",
      "nivel_afinidad": "Muy Alta" | "Alta" | "Exploratoria",
      "justificacion": "Explicación ceñida a los datos reales"
    }}
  ]
}}"""

# Response contracts: list field and item fields of each answer kind.
DIRECT_RESPONSE_LIST = "recomendaciones"
DIRECT_RESPONSE_FIELDS = ["nombre_sitio", "categoria_sitio", "ubicacion", "nivel_afinidad", "justificacion"]
INVERSE_RESPONSE_LIST = "usuarios_recomendados"
INVERSE_RESPONSE_FIELDS = ["id_usuario", "nombre", "tipo_viajero", "justificacion_target"]
