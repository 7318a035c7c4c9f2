"""Fixed values of the domain: labels, thresholds in COP, word lists, code maps and messages."""

# Quality classes and error types (fixed values).
OK = "OK"
WARNING = "ADVERTENCIA"
ERROR = "ERROR"
EXTREME_VALUE = "VALOR_EXTREMO_DIGITACION"
MARKET_WITHOUT_VALUE = "MERCADO_SIN_VALOR"
BAD_GEOGRAPHY = "GEOGRAFIA_INVALIDA"
BAD_YEAR = "YEAR_INVALIDO"
BAD_MARKET_FLAG = "DINAMICA_INVALIDA"
TINY_VALUE = "VALOR_IRRISIORIO"
BAD_PROPERTY_KIND = "TIPO_PREDIO_INVALIDO"
PENDING = "PENDIENTE"

# Thresholds (fixed values, Colombian pesos, years and counts).
MIN_VALID_VALUE = 1_000_000
MAX_VALID_VALUE = 10_000_000_000
FIRST_VALID_YEAR = 2000
LAST_VALID_YEAR = 2025
MAX_ANNOTATIONS_PER_YEAR = 150
LOW_VALUE = 10_000_000
HIGH_VALUE = 5_000_000_000
MAX_ACCEPTED_VALUE = 1_000_000_000_000
MAX_ACCEPTED_AREA = 100_000_000
RISK_THRESHOLD = 0.7

# Acts that require a value and accepted property kinds (fixed values).
VALUED_ACTS = "COMPRAVENTA|HIPOTECA|VENTA|MUTUO"
PROPERTY_KINDS = ["URBANO", "RURAL", "SIN INFORMACION", "MIXTO"]

# Colombian departments (fixed values).
DEPARTMENTS = [
    "AMAZONAS", "ANTIOQUIA", "ARAUCA", "ATLANTICO", "BOLIVAR", "BOYACA", "CALDAS", "CAQUETA",
    "CASANARE", "CAUCA", "CESAR", "CHOCO", "CORDOBA", "CUNDINAMARCA", "GUAINIA", "GUAVIARE",
    "HUILA", "LA GUAJIRA", "MAGDALENA", "META", "NARIÑO", "NORTE DE SANTANDER", "PUTUMAYO",
    "QUINDIO", "RISARALDA", "SAN ANDRES", "SANTANDER", "SUCRE", "TOLIMA", "VALLE DEL CAUCA",
    "VAUPES", "VICHADA",
]

# Code maps of the online feature vector (fixed values).
ACT_CODES = {
    "compraventa": 1.0, "hipoteca": 2.0, "donacion": 3.0, "permuta": 4.0,
    "dacion_pago": 5.0, "adjudicacion": 6.0, "sucesion": 7.0, "otro": 8.0,
}
PROPERTY_KIND_CODES = {"urbano": 1.0, "rural": 2.0, "mixto": 3.0}
FOLIO_STATE_CODES = {"activo": 1.0, "cancelado": 2.0, "cerrado": 3.0, "suspendido": 4.0}

# Raw registry column -> transaction column (fixed values).
REGISTRY_NAMES = {
    "PK": "pk",
    "MATRICULA": "matricula",
    "FECHA_RADICA_TEXTO": "fecha_radicacion",
    "FECHA_APERTURA_TEXTO": "fecha_apertura",
    "YEAR_RADICA": "year_radica",
    "ORIP": "orip",
    "DIVIPOLA": "divipola",
    "DEPARTAMENTO": "departamento",
    "MUNICIPIO": "municipio",
    "TIPO_PREDIO_ZONA": "tipo_predio",
    "CATEGORIA_RURALIDAD": "categoria_ruralidad",
    "NUM_ANOTACION": "num_anotacion",
    "ESTADO_FOLIO": "estado_folio",
    "FOLIOS_DERIVADOS": "folios_derivados",
    "COD_NATUJUR": "cod_natujur",
    "NOMBRE_NATUJUR": "nombre_natujur",
    "NUMERO_CATASTRAL": "numero_catastral",
    "NUMERO_CATASTRAL_ANTIGUO": "numero_catastral_antiguo",
    "DOCUMENTO_JUSTIFICATIVO": "documento_justificativo",
    "COUNT_A": "count_a",
    "COUNT_DE": "count_de",
    "PREDIOS_NUEVOS": "predios_nuevos",
    "TIENE_VALOR": "tiene_valor",
    "TIENE_MAS_DE_UN_VALOR": "tiene_mas_de_un_valor",
    "Dinámica_Inmobiliaria": "dinamica_inmobiliaria",
    "VALOR": "valor_acto",
}

# Bounds of the clamping cleaner: below the minimum is dropped, above the maximum is clamped
# (fixed values).
CLAMP_BOUNDS = {
    "valor_acto": (0, 1e12),
    "area_terreno": (0, 1e8),
    "area_construida": (0, 1e8),
    "numero_intervinientes": (1, 100),
    "count_a": (0, 100),
    "count_de": (0, 100),
    "orip": (0, 10000),
}

# Histogram edges and labels (fixed values).
VALUE_EDGES_5 = [0, 10_000_000, 50_000_000, 100_000_000, 500_000_000, None]
VALUE_LABELS_5 = ["< 10M", "10M-50M", "50M-100M", "100M-500M", "> 500M"]
VALUE_EDGES_6 = [1_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 10_000_000_000]
VALUE_LABELS_6 = ["1M-10M", "10M-50M", "50M-100M", "100M-500M", "500M-1B", "1B-10B"]
SCORE_BANDS = [(0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8"), (None, "0.8-1.0")]
SCORE_BANDS_NAMED = [
    (0.2, "Muy bajo (0.0-0.2)"), (0.4, "Bajo (0.2-0.4)"), (0.6, "Medio (0.4-0.6)"),
    (0.8, "Alto (0.6-0.8)"), (None, "Muy alto (0.8-1.0)"),
]

# Validation messages (fixed values).
INVALID_VALUE = "valor_acto must be positive"
VALUE_TOO_LARGE = "valor_acto exceeds reasonable maximum"
FUTURE_DATE = "fecha_acto cannot be in the future"
DATE_TOO_OLD = "fecha_acto too far in the past"
TOO_FEW_PARTIES = "numero_intervinientes must be at least 1"
TOO_MANY_PARTIES = "numero_intervinientes exceeds reasonable maximum"
NEGATIVE_LAND = "area_terreno cannot be negative"
LAND_TOO_LARGE = "area_terreno exceeds reasonable maximum"
NEGATIVE_BUILT = "area_construida cannot be negative"
BUILT_OVER_LAND = "area_construida cannot exceed area_terreno"
BAD_CADASTRAL = "numero_catastral format is invalid"
BAD_FOLIO = "matricula_inmobiliaria format is invalid"

# Texts of the transaction analysis (fixed values).
LOW_VALUE_NOTE = "Valor significativamente inferior al mercado"
PARTIES_NOTE = "Número inusual de intervinientes en la transacción"
FOLIO_NOTE = "Estado del folio requiere verificación"
NORMAL_ADVICE = ["Transacción dentro de parámetros normales"]
SUSPICIOUS_ADVICE = [
    "Verificar identidad de todos los intervinientes",
    "Solicitar avalúo catastral actualizado",
]
HIGH_RISK_ADVICE = [
    "Revisión manual obligatoria antes de registro",
    "Verificar origen de fondos",
    "Consultar antecedentes registrales",
]

# Property alerts, heuristic form (fixed values).
ALERT_RATE = "⚠️ Alta tasa de transacciones anómalas ("
ALERT_SCORE_HIGH = "🚨 Score de riesgo elevado - Revisar historial detalladamente"
ALERT_SCORE_MEDIUM = "⚠️ Score de riesgo moderado - Se recomienda precaución"
ALERT_HISTORY = "📊 Propiedad con historial amplio ("
ALERT_SPREAD = "📈 Variabilidad significativa de precios en el historial"
ALERT_NONE = "[OK] No se detectaron senales de alerta significativas"

# Property alerts, stored-score form (fixed values).
STORED_RATE_HIGH = "ALERTA: Más del 50% de las transacciones presentan señales de anomalía."
STORED_RATE_MEDIUM = "ADVERTENCIA: Tasa elevada de transacciones anómalas detectadas."
STORED_SCORE_HIGH = "RIESGO ALTO: La propiedad tiene un score de riesgo elevado."
STORED_SCORE_MEDIUM = "RIESGO MEDIO: Se recomienda revisión adicional de las transacciones."
STORED_SINGLE = "Información limitada: Solo se encontró una transacción registrada."
STORED_LOW_PRICES = "ADVERTENCIA: Valores de transacción inusualmente bajos detectados."
STORED_NONE = "No se detectaron señales de riesgo significativas."

# Valuation verdicts (fixed values).
PRICE_NORMAL = "[OK] Precio dentro del rango esperado para transacciones similares en esta zona"
PRICE_CAUTION = "[WARN] Precio con desviación moderada. Revisar detalles de la transacción"
PRICE_LOW = "[ALERT] Precio significativamente BAJO. Posible subvaluación o fraude"
PRICE_HIGH = "[ALERT] Precio significativamente ALTO. Posible sobrevaloración"
PRICE_CAUTION_ADVICE = [
    "Verificar características específicas del inmueble",
    "Comparar con transacciones recientes en la misma zona",
    "Consultar avalúo catastral actualizado",
]
PRICE_LOW_ADVICE = [
    "[!] Revisar si existe un avalúo independiente reciente",
    "[!] Verificar estado real del inmueble",
    "[!] Consultar si existen gravámenes o limitaciones",
    "[!] Validar identidad de compradores y vendedores",
    "[!] Considerar auditoría adicional",
]
PRICE_HIGH_ADVICE = [
    "Verificar mejoras o características premium no declaradas",
    "Comparar con avalúo comercial reciente",
    "Revisar si incluye bienes muebles o servicios adicionales",
]
