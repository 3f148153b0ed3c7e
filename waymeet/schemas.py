"""Schemas of all tables, as DDL, and the fixed vocabularies."""

from __future__ import annotations

#: Object class codes and mean sizes in metres: name, code, length, width, height (fixed values of the data format).
OBJECT_CLASSES = [
    ("motorcycle", 110, 1.82, 0.86, 1.54),
    ("car", 210, 3.64, 1.82, 1.39),
    ("truck", 410, 7.47, 2.59, 2.67),
    ("bus", 610, 13.45, 2.94, 2.70),
    ("person", 810, 0.70, 0.68, 1.58),
    ("bicycle", 910, 1.65, 0.74, 1.58),
    ("e-scooter", 920, 1.27, 0.57, 1.65),
]
#: Speeds in km/h that tracks of a class start with, and the highest cost at which a detection continues one (fixed values).
START_KMH = {"motorcycle": 30, "car": 50, "truck": 25, "bus": 25, "person": 7, "bicycle": 15, "e-scooter": 20}
COST_LIMITS = {"motorcycle": 7.5, "car": 9.0, "truck": 9.0, "bus": 9.0, "person": 2.5, "bicycle": 5.0, "e-scooter": 5.0}
VULNERABLE = ("person", "bicycle", "e-scooter")
MANEUVERS = (
    "Following", "Head-on", "Crossing", "Merging", "Diverging",
    "Turn-left-across-path", "Turn-right-across-path", "Check individual",
)
FRAME_US = 33_333
FPS = 30

RECORDS = "RecordID long, RecordFrameStartTime string"
DETECTIONS = (
    "id_sensor int, id_record long, frame_id long, frame_ts timestamp_ntz, bbox_2d array<double>, keypoint_image array<double>, "
    "keypoint_world array<double>, score double, class_name string, dimensions array<double>, yaw double"
)
TRAJ_POINTS = (
    "idMeasurementSeries int, idSensor int, idRecord long, FrameTimeStamp timestamp_ntz, FrameTimeStamp_MicroSec int, idVehicle long, "
    "ObjectClass int, Length double, Width double, Height double, posXFit double, posYFit double, posZFit double, YawFit double, "
    "VxFit double, VyFit double, VzFit double, AxFit double, AyFit double, AzFit double, YawRateFit double, Cluster int"
)
_MOTION = ("posX", "posY", "posZ", "Yaw", "Vx", "Vy", "Vz", "Ax", "Ay", "Az", "YawRate")
TRAJ_POINTS_RAW = (
    "idMeasurementSeries int, idSensor int, idRecord long, FrameTimeStamp timestamp_ntz, FrameTimeStamp_MicroSec int, "
    "SystemTimeStamp timestamp_ntz, SystemTimeStamp_MicroSec int, idVehicle long, ObjectClass int, Length double, Width double, Height double, "
    + ", ".join(f"{c} double" for c in _MOTION) + ", " + ", ".join(f"{c}Fit double" for c in _MOTION)
)
CONFLICTS = (
    "idMeasurementSeries int, idSensor int, idRecord long, FrameTimeStamp timestamp_ntz, FrameTimeStamp_MicroSec int, "
    "TimeStamp timestamp_ntz, TimeStamp_MicroSec int, Indicator string, idVehicle1 long, idVehicle2 long, Vehicle_Class_1 string, "
    "Vehicle_Class_2 string, Vehicle_Cluster_1 int, Vehicle_Cluster_2 int, posX double, posY double, Value double, Auto_Type string, "
    "Auto_Rule_Flag boolean, LOF1 double, LOF2 double, Manual_Type string, Manual_Rule_Flag boolean, Manual_Conflict_Check boolean"
)
MANEUVER_CLASSES = "ClusterVehicle1 int, ClusterVehicle2 int, ManeuverClass string"
RULES = "cluster_A int, cluster_B int, A_as_vehicle1 long, B_as_vehicle1 long, total_pairs long"
CLUSTER_MEANS = "cluster_id int, cx array<double>, cy array<double>, cz array<double>"
ZONES = "zone_id int, name string, vertices array<struct<x: double, y: double>>"
OBJECT_SIZES = "class_name string, class_code int, length double, width double, height double"
