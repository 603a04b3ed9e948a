"""A data dictionary of standard attributes (DICOM PS3.6), as Python lookups and as a relation."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

_LINES = """
00020000 FileMetaInformationGroupLength UL 1
00020001 FileMetaInformationVersion OB 1
00020002 MediaStorageSOPClassUID UI 1
00020003 MediaStorageSOPInstanceUID UI 1
00020010 TransferSyntaxUID UI 1
00020012 ImplementationClassUID UI 1
00020013 ImplementationVersionName SH 1
00020016 SourceApplicationEntityTitle AE 1
00020017 SendingApplicationEntityTitle AE 1
00020018 ReceivingApplicationEntityTitle AE 1
00020100 PrivateInformationCreatorUID UI 1
00020102 PrivateInformation OB 1
00080005 SpecificCharacterSet CS 1-n
00080008 ImageType CS 2-n
00080012 InstanceCreationDate DA 1
00080013 InstanceCreationTime TM 1
00080016 SOPClassUID UI 1
00080018 SOPInstanceUID UI 1
00080020 StudyDate DA 1
00080021 SeriesDate DA 1
00080022 AcquisitionDate DA 1
00080023 ContentDate DA 1
0008002A AcquisitionDateTime DT 1
00080030 StudyTime TM 1
00080031 SeriesTime TM 1
00080032 AcquisitionTime TM 1
00080033 ContentTime TM 1
00080050 AccessionNumber SH 1
00080060 Modality CS 1
00080064 ConversionType CS 1
00080068 PresentationIntentType CS 1
00080070 Manufacturer LO 1
00080080 InstitutionName LO 1
00080081 InstitutionAddress ST 1
00080090 ReferringPhysicianName PN 1
00080100 CodeValue SH 1
00080102 CodingSchemeDesignator SH 1
00080104 CodeMeaning LO 1
00081010 StationName SH 1
00081030 StudyDescription LO 1
00081032 ProcedureCodeSequence SQ 1
0008103E SeriesDescription LO 1
00081040 InstitutionalDepartmentName LO 1
00081050 PerformingPhysicianName PN 1-n
00081070 OperatorsName PN 1-n
00081090 ManufacturerModelName LO 1
00081110 ReferencedStudySequence SQ 1
00081111 ReferencedPerformedProcedureStepSequence SQ 1
00081115 ReferencedSeriesSequence SQ 1
00081140 ReferencedImageSequence SQ 1
00081150 ReferencedSOPClassUID UI 1
00081155 ReferencedSOPInstanceUID UI 1
00082144 RecommendedDisplayFrameRate IS 1
00100010 PatientName PN 1
00100020 PatientID LO 1
00100021 IssuerOfPatientID LO 1
00100030 PatientBirthDate DA 1
00100032 PatientBirthTime TM 1
00100040 PatientSex CS 1
00101000 OtherPatientIDs LO 1-n
00101010 PatientAge AS 1
00101020 PatientSize DS 1
00101030 PatientWeight DS 1
00102160 EthnicGroup SH 1
001021B0 AdditionalPatientHistory LT 1
00104000 PatientComments LT 1
00120062 PatientIdentityRemoved CS 1
00120063 DeidentificationMethod LO 1-n
00180010 ContrastBolusAgent LO 1
00180015 BodyPartExamined CS 1
00180020 ScanningSequence CS 1-n
00180040 CineRate IS 1
00180050 SliceThickness DS 1
00180060 KVP DS 1
00180080 RepetitionTime DS 1
00180081 EchoTime DS 1
00180088 SpacingBetweenSlices DS 1
00181000 DeviceSerialNumber LO 1
00181020 SoftwareVersions LO 1-n
00181030 ProtocolName LO 1
00181063 FrameTime DS 1
00181065 FrameTimeVector DS 1-n
00181100 ReconstructionDiameter DS 1
00181150 ExposureTime IS 1
00181151 XRayTubeCurrent IS 1
00181164 ImagerPixelSpacing DS 2
00185100 PatientPosition CS 1
00189073 AcquisitionDuration FD 1
0020000D StudyInstanceUID UI 1
0020000E SeriesInstanceUID UI 1
00200010 StudyID SH 1
00200011 SeriesNumber IS 1
00200012 AcquisitionNumber IS 1
00200013 InstanceNumber IS 1
00200020 PatientOrientation CS 2
00200032 ImagePositionPatient DS 3
00200037 ImageOrientationPatient DS 6
00200052 FrameOfReferenceUID UI 1
00201041 SliceLocation DS 1
00204000 ImageComments LT 1
00209165 DimensionIndexPointer AT 1
00280002 SamplesPerPixel US 1
00280004 PhotometricInterpretation CS 1
00280006 PlanarConfiguration US 1
00280008 NumberOfFrames IS 1
00280009 FrameIncrementPointer AT 1-n
00280010 Rows US 1
00280011 Columns US 1
00280030 PixelSpacing DS 2
00280034 PixelAspectRatio IS 2
00280100 BitsAllocated US 1
00280101 BitsStored US 1
00280102 HighBit US 1
00280103 PixelRepresentation US 1
00280106 SmallestImagePixelValue US 1
00280107 LargestImagePixelValue US 1
00280120 PixelPaddingValue US 1
00280301 BurnedInAnnotation CS 1
00281050 WindowCenter DS 1-n
00281051 WindowWidth DS 1-n
00281052 RescaleIntercept DS 1
00281053 RescaleSlope DS 1
00281054 RescaleType LO 1
00281055 WindowCenterWidthExplanation LO 1-n
00281101 RedPaletteColorLookupTableDescriptor US 3
00281102 GreenPaletteColorLookupTableDescriptor US 3
00281103 BluePaletteColorLookupTableDescriptor US 3
00281201 RedPaletteColorLookupTableData OW 1
00281202 GreenPaletteColorLookupTableData OW 1
00281203 BluePaletteColorLookupTableData OW 1
00282110 LossyImageCompression CS 1
00283000 ModalityLUTSequence SQ 1
00283010 VOILUTSequence SQ 1
00321060 RequestedProcedureDescription LO 1
00400244 PerformedProcedureStepStartDate DA 1
00400254 PerformedProcedureStepDescription LO 1
00400275 RequestAttributesSequence SQ 1
00400007 ScheduledProcedureStepDescription LO 1
00400009 ScheduledProcedureStepID SH 1
00401001 RequestedProcedureID SH 1
0040A010 RelationshipType CS 1
0040A030 VerificationDateTime DT 1
0040A040 ValueType CS 1
0040A043 ConceptNameCodeSequence SQ 1
0040A120 DateTime DT 1
0040A160 TextValue UT 1
0040A168 ConceptCodeSequence SQ 1
0040A300 MeasuredValueSequence SQ 1
0040A30A NumericValue DS 1-n
0040A730 ContentSequence SQ 1
00420010 DocumentTitle ST 1
00420011 EncapsulatedDocument OB 1
00420012 MIMETypeOfEncapsulatedDocument LO 1
00540081 NumberOfSlices US 1
00686300 OverallTemplateSpatialTolerance FD 1
0066000F DoubleFloatSurfacePointsDummy OD 1
00660016 PointCoordinatesData OF 1
00720066 SelectorAEValue AE 1-n
00720072 SelectorFDValue FD 1-n
00720074 SelectorDSDummy DS 1-n
00720075 SelectorFLDummy FL 1-n
00720076 SelectorFLValue FL 1-n
00720078 SelectorULValue UL 1-n
0072007A SelectorUSValue US 1-n
0072007C SelectorSLValue SL 1-n
0072007E SelectorSSValue SS 1-n
00720080 SelectorCodeSequenceValue SQ 1
00720082 SelectorSVValue SV 1-n
00720083 SelectorUVValue UV 1-n
00720062 SelectorCSValue CS 1-n
00720064 SelectorISValue IS 1-n
00720071 SelectorURValue UR 1
0072006F SelectorUCValue UC 1-n
00720060 SelectorATValue AT 1-n
0072006D SelectorUNValue UN 1
00720065 SelectorOBValue OB 1
00720069 SelectorOWValue OW 1
00720067 SelectorOFValue OF 1
00720073 SelectorODValue OD 1
0072006B SelectorOLDummy OL 1
00720081 SelectorOVValue OV 1
00720079 SelectorOLValue OL 1
00089459 RecommendedDisplayFrameRateInFloat FL 1
54000100 WaveformSequence SQ 1
54001010 WaveformData OW 1
7FE00001 ExtendedOffsetTable OV 1
7FE00002 ExtendedOffsetTableLengths OV 1
7FE00003 EncapsulatedPixelDataValueTotalLength UV 1
7FE00008 FloatPixelData OF 1
7FE00009 DoubleFloatPixelData OD 1
7FE00010 PixelData OW 1
FFFAFFFA DigitalSignaturesSequence SQ 1
"""

_DUMMY = {"DoubleFloatSurfacePointsDummy", "SelectorDSDummy", "SelectorFLDummy", "SelectorOLDummy"}
ENTRIES: list[tuple[int, str, str, str]] = [(int(t, 16), k, v, m) for t, k, v, m in (x.split() for x in _LINES.split("\n") if x) if k not in _DUMMY]
BY_TAG = {t: (k, v, m) for t, k, v, m in ENTRIES}
BY_KEYWORD = {k: t for t, k, _, _ in ENTRIES}
#: Repeating groups: the dictionary has one entry for many groups, so their keys stay hexadecimal.
REPEATING = {0x5000: "curve", 0x6000: "overlay"}

BULK_VRS = frozenset("OB OD OF OL OV OW UN".split())
TEXT_VRS = frozenset("LT ST UR UT".split())
STRING_VRS = frozenset("AE AS CS DA DS DT IS LO PN SH TM UC UI".split())
ALL_VRS = STRING_VRS | TEXT_VRS | BULK_VRS | frozenset("AT FD FL SL SQ SS SV UL US UV".split())


def is_group_length(tag: int) -> bool:
    return tag & 0xFFFF == 0


def is_private_creator(tag: int) -> bool:
    return (tag >> 16) & 1 == 1 and 0x10 <= tag & 0xFFFF <= 0xFF


def keyword(tag: int) -> str | None:
    """Keyword of a standard attribute that has an entry of its own."""
    x = BY_TAG.get(tag)
    return x[0] if x else None


def vr_of(tag: int) -> str:
    """The dictionary's value representation; UN for what it doesn't list, UL for group lengths, LO for private creators."""
    if tag in BY_TAG:
        return BY_TAG[tag][1]
    return "UL" if is_group_length(tag) else "LO" if is_private_creator(tag) else "UN"


def hex_key(tag: int) -> str:
    return f"{tag:08X}"


def expression(tag: int) -> str:
    return f"({tag >> 16:04X},{tag & 0xFFFF:04X})"


def must_be_hex(tag: int) -> bool:
    return (tag >> 16) & 1 == 1 or tag not in BY_TAG or is_group_length(tag)


def flat_key(tag: int, style: str = "name") -> str:
    return hex_key(tag) if style == "hex" or must_be_hex(tag) else BY_TAG[tag][0]


def parse_tag(key: str) -> int | None:
    """A tag from a keyword, ``GGGGEEEE``, ``GGGG,EEEE`` or ``(GGGG,EEEE)``."""
    k = key.strip()
    if k in BY_KEYWORD:
        return BY_KEYWORD[k]
    if k.startswith("(") and k.endswith(")"):
        k = k[1:-1]
    if len(k) == 9 and k[4] == ",":
        k = k[:4] + k[5:]
    if len(k) == 8 and all(c in "0123456789abcdefABCDEF" for c in k):
        return int(k, 16)
    return None


@cache
def rows() -> list[tuple[int, str, str, str, str]]:
    return [(t, hex_key(t), k, v, m) for t, k, v, m in ENTRIES]


def relation(spark: SparkSession) -> DataFrame:
    """The dictionary as a table of fixed size: tag, tag_hex, keyword, vr, vm."""
    return spark.createDataFrame(rows(), "tag bigint, tag_hex string, keyword string, vr string, vm string")
