"""Fixed names of the fact model: namespaces, record kinds, well-known predicates and classes."""

NS = "http://fogid.net/o/"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML_NS = "http://www.w3.org/XML/1998/namespace"
RDF_TYPE = RDF_NS + "type"

ROOT_COLLECTION_ID = "cassetterootcollection"
ROOT_COLLECTION_NAME = "кассеты"
SYSTEM_CASSETTE = "$system"
SYNTHETIC_PATH = "$synthetic"
SYNTHETIC_ORDINAL = "synthetic"
UNKNOWN_TYPE = "$unknown"

# record and value kinds
RESOURCE, DELETE, SUBSTITUTE = "resource", "delete", "substitute"
LITERAL, IRI, BLANK = "literal", "iri", "bnode"

# ontology term kinds
CLASS, DATATYPE_PROPERTY = "Class", "DatatypeProperty"
OBJECT_PROPERTY, ENUMERATION = "ObjectProperty", "EnumerationType"

# predicates
NAME, ALIAS = NS + "name", NS + "alias"
DESCRIPTION, DOC_CONTENT = NS + "description", NS + "doc-content"
URI, ROLE = NS + "uri", NS + "role"
DATE, FROM_DATE, TO_DATE = NS + "date", NS + "from-date", NS + "to-date"
REFLECTED, IN_DOC = NS + "reflected", NS + "in-doc"
PARTICIPANT, IN_ORG = NS + "participant", NS + "in-org"
IN_COLLECTION, COLLECTION_ITEM = NS + "in-collection", NS + "collection-item"

# classes
ENTITY, SYSTEM_OBJECT = NS + "entity", NS + "sys-obj"
ORGANIZATION, COLLECTION = NS + "org-sys", NS + "collection"
DOCUMENT, PHOTO_DOCUMENT = NS + "document", NS + "photo-doc"
REFLECTION, PARTICIPATION = NS + "reflection", NS + "participation"
COLLECTION_MEMBER = NS + "collection-member"
TECHNICAL_TYPES = (REFLECTION, PARTICIPATION, COLLECTION_MEMBER)

NAME_PREDICATES = (NAME, ALIAS)
WORD_PREDICATES = (NAME, ALIAS, DESCRIPTION, DOC_CONTENT)
DATE_PREDICATES = (FROM_DATE, TO_DATE, DATE)

# ranges whose values are never compared as text
NON_TEXT_RANGES = tuple(
    NS + n for n in ("boolean", "bool", "integer", "int", "long", "float", "double", "decimal", "date"))

# rights
READ, SEARCH, REBUILD_INDEX = "read", "search", "rebuildIndex"
PROJECT_RIGHTS = ("read", "search", "export", "manageUsers", "manageCassettes", "rebuildIndex")
WRITE_RIGHTS = ("writeMetadata", "addDocuments", "replaceDocuments", "delete", "substitute", "manage")
CASSETTE_RIGHTS = ("read",) + WRITE_RIGHTS

# labels shown where the data gives none
LABEL_PARTICIPANT = "участник"
LABEL_PARTICIPATION = "участие"
LABEL_COLLECTION_ITEM = "элемент коллекции"
LABEL_IN_COLLECTION = "в коллекции"
LABEL_RELATION = "Связь"
LABEL_RELATIONS = "Связи"
LABEL_DOCUMENT = "Документ"
LABEL_RESOURCE = "Ресурс"
LABEL_NO_TYPE = "Тип не указан"
LABEL_REFLECTED = "Отражены"
LABEL_PHOTOS = "Фотографии"
