"""Read schemas. Every source declares its schema; none is inferred."""

EVENT_LINE = (
    "`Event` STRING, `Timestamp` BIGINT, `App Name` STRING, `App ID` STRING, `Executor ID` STRING"
)
STAGES = "ARRAY<STRUCT<stageId:INT,submissionTime:STRING,completionTime:STRING>>"
READ_METRICS = "STRUCT<bytesRead:BIGINT,recordsRead:BIGINT>"
WRITE_METRICS = "STRUCT<bytesWritten:BIGINT,recordsWritten:BIGINT>"
SHUFFLE_READ = (
    "STRUCT<remoteBlocksFetched:BIGINT,localBlocksFetched:BIGINT,fetchWaitTime:BIGINT,"
    "remoteBytesRead:BIGINT,localBytesRead:BIGINT,recordsRead:BIGINT>"
)
SHUFFLE_WRITE = "STRUCT<bytesWritten:BIGINT,writeTime:BIGINT,recordsWritten:BIGINT>"
TASK_METRICS = (
    "STRUCT<executorDeserializeTime:BIGINT,executorRunTime:BIGINT,resultSize:BIGINT,jvmGcTime:BIGINT,"
    "resultSerializationTime:BIGINT,memoryBytesSpilled:BIGINT,diskBytesSpilled:BIGINT,"
    f"inputMetrics:{READ_METRICS},outputMetrics:{WRITE_METRICS},"
    f"shuffleReadMetrics:{SHUFFLE_READ},shuffleWriteMetrics:{SHUFFLE_WRITE}>"
)
TASKS = (
    "ARRAY<STRUCT<taskId:BIGINT,host:STRING,executorId:STRING,taskLocality:STRING,errorMessage:STRING,"
    f"taskMetrics:{TASK_METRICS}>>"
)
NODE_METRICS = "timestamp BIGINT, values STRUCT<sigar:MAP<STRING,DOUBLE>,filesystem:MAP<STRING,DOUBLE>>"
FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
