"""Fixed shapes: change events, stream records, and the rows of state tables."""

from __future__ import annotations

RECORD_TYPES = ("INSERT", "MODIFY", "REMOVE")

#: A change event as a feed delivers it. Documents are VARIANT: missing, null and types stay apart.
CHANGE = "_id struct<_data string>, operationType string, clusterTime struct<t bigint, i int>, documentKey variant, fullDocument variant, fullDocumentBeforeChange variant"
#: The same as text, for files: documents are JSON strings.
CHANGE_TEXT = CHANGE.replace("variant", "string")
RECORD = "tableName string, recordType string, newImage variant, oldImage variant, timestamp timestamp, eventId string, documentId string"
OUTCOME = "eventId string, sinkId string, ok boolean, error string, seconds double, wait double, full boolean"
RETRY = "id string, collectionName string, eventData string, retryCount int, maxRetries int, nextRetryAt timestamp, lastError string, version long, removed boolean"
DLQ = "_id string, collectionName string, sinkId string, eventData string, lastError string, failedAt timestamp, dedupKey string"
COLLECTION = "collectionName string, partitionKey string, sortKey string, streamEnabled boolean, oldImage boolean, ttlAttribute string, deletionProtection boolean"
SINK = "id string, collectionId string, type string, spec string, eventTypes array<string>, filter string, fingerprint string"
